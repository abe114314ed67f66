"""Secret scan with a random forest against false positives, in SQL functions alone.

Candidates are all runs of ten or more key characters, whatever they are joined
to, and all values after a password or secret word or in the user part of a URL,
of any length and with any characters.  Only the forest rejects.  A value and a
run within it are both scored; the value counts if both are found.
Each candidate gets numbers for its length,
character classes and transitions, entropy, dictionary coverage, path signs and
neighbouring words.  A random forest, trained from labelled findings, decides.
Its trees become one CASE expression, so scan, scoring and redaction are a
projection of each row: no Python on executors, no shuffle, no state.

``labelled_findings`` makes the default training set (documented size, fixed
seed): credentials of public formats in code and prose against the usual false
positives - digests, ids, paths, placeholders, numbers.  Pass your own
DataFrame (context, piece, follow, label) to replace it; at most ``MAX_FINDINGS``
rows are used, by smallest hash.

Defined results: null texts have no findings and stay null; empty ones stay
empty.  Rows pass one by one, so repeats, ties and other columns are untouched.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.llm._shared import has, packed, table, unpacked

MAX_FINDINGS = 6000
TREES, DEPTH, LEAST_LEAF = 24, 6, 5
THRESHOLD = 0.5
MARK = "[SECRET]"

#: Keys of public services that are told from what stands before them, even a key character.
_SHAPE = "(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pos]_[A-Za-z0-9]{20}|github_pat_[A-Za-z0-9]{10}|glpat-[A-Za-z0-9_-]{16}|[sr]k_live_[A-Za-z0-9]{10}|xox[abprs]-[A-Za-z0-9]{8}|AIza[A-Za-z0-9_-]{30}"
#: Pieces of a text: runs of ten or more key characters, and what stands between two.  An escape before a key belongs to what stands before.
_PIECE = (
    rf"""[\\w+/.-]{{10,}}+|(?:[^\\w+/.%\\\\-]++|[\\w+/.-]{{1,9}}+(?![\\w+/.-])|%[0-9A-Fa-f]{{2}}(?=[\\w+/.-]{{10}})|\\\\[nrt](?={_SHAPE})|[%\\\\])++"""
)
#: Cut a run before each key that its shape tells.
_CUT = rf"(?<=[_+/.-])(?={_SHAPE})"
_RUN = r"^[\\w+/.-]{10}"
_KEY = r"""[A-Za-z0-9][A-Za-z0-9_+/.-]{8,}[A-Za-z0-9]"""

#: How keys of public services begin.
_PREFIX = "(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abprs]-|AIza|eyJ|SG[.])"

#: Words that ask for a secret.
_PASS = "passw|passphrase|passcode|pwd|[_-]pass(?![a-z])"
_ASKS = f"{_PASS}|secret|token|api.?key|access.?key|private.?key|auth(?!or(?!i[sz]))|bearer|credential"
#: A value and what asks for it (group 1): a word with a sign or blanks after it, or the user part of a URL.  Values in quotes end with these, others before white space.
_NAME = rf"""(?:{_ASKS})[a-z0-9_-]*["'`\\])]{{0,2}}[ \\t]*"""
_SIGN = r"""(?:=>|[:=]=?|>)"""
_END = r"""[.,;:&|)\\]}>']{0,3}(?:[\\s"`]|$|</|'[^A-Za-z0-9]|[,;&|][A-Za-z_][A-Za-z0-9_.-]*=)"""
_VALUE = (
    rf"""(?i)(?=[pstabc_:-])(?:((?:{_NAME}{_SIGN}[ \\t]*(?:(?:bearer|basic|token)[ \\t]+)?|(?:{_ASKS})(?:ord|wd|d|s|ization)*(?:[ \\t]+is)?[ \\t]+)["'`]?)(?![({{\\[]{{0,2}}{_NAME}[:=])"""
    rf"""(?:(?<=")(?!")[^\\n]+?(?<!\\\\)(?=")|(?<=')(?!')[^\\n]+?(?<!\\\\)(?=')|(?<=`)(?!`)[^\\n]+?(?=`)|(?!['<])[^\\s"`]+?(?={_END}))"""
    r"""|(://[^\\s/:@"'<>]*:)[^\\s/"'<>]+(?=@))"""
)

#: What any value needs somewhere in its text, in lower case: plain searches for these spare most texts the pattern.
_SIGNS = ("passw", "passphrase", "passcode", "pwd", "_pass", "-pass", "secret", "token", "key", "auth", "bearer", "credential", "://")

#: How many characters before and after a candidate the features see.
BEFORE, AFTER = 60, 24

#: Common words of four languages, for dictionary coverage.
WORDS = (
    "the and that with for this from have not are was but they which one all there were when your can said use each she how their will other about out many then them these some her would make like "
    "into time has look two more write see number way could people than first water been call who its now find long down day did get come made may part file data user name test image page index "
    "config example change order version release home site public static assets node module report total model table value der die und das ist mit ein eine für auf den von nicht werden les des est "
    "que pas pour dans une sur avec los las del por con para como mas este"
).split()
_DICT = "|".join(sorted({w for w in WORDS if len(w) >= 3}, key=lambda w: (-len(w), w)))

#: Words near digests, ids and examples.
_BENIGN = ("md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "revision", "version", "order", "invoice", "phone", "isbn", "serial", "build", "image", "example", "placeholder", "dummy", "sample")


def _holds(text: str, words) -> str:
    """Whether the SQL expression ``text`` holds any of ``words``: plain searches, much cheaper than a pattern of alternatives."""
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


#: Each feature as SQL over t (the candidate), c (what stands before it), f (what follows), l (c in lower case), n (c and f in lower case) and a (whether l may ask for a secret).
FEATURES = {
    "len": "CAST(length(t) AS DOUBLE)",
    "digits": "regexp_count(t, '[0-9]') / length(t)",
    "uppers": "regexp_count(t, '[A-Z]') / length(t)",
    "lowers": "regexp_count(t, '[a-z]') / length(t)",
    "marks": "regexp_count(t, '[_+/.-]') / length(t)",
    "distinct": "size(array_distinct(split(t, ''))) / length(t)",
    "class_moves": "regexp_count(t, '(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])') / length(t)",
    "vowel_moves": "regexp_count(lower(t), '(?<=[aeiou])(?=[bcdfghjklmnpqrstvwxyz])|(?<=[bcdfghjklmnpqrstvwxyz])(?=[aeiou])') / length(t)",
    "run_moves": "regexp_count(t, '(.)(?=\\\\1)') / length(t)",
    "hex": "CAST(t RLIKE '^[0-9a-f]+$' OR t RLIKE '^[0-9A-F]+$' AS DOUBLE)",
    "entropy": "-aggregate(array_distinct(split(t, '')), 0D, (s, x) -> s + (length(t) - length(replace(t, x, ''))) / length(t) * ln((length(t) - length(replace(t, x, ''))) / length(t)))",
    "words": f"1 - length(regexp_replace(lower(t), '{_DICT}', '')) / length(t)",
    "path": "CAST(t RLIKE '/.*/|^/|[.][a-z]{1,4}$' OR (contains(c, '/') OR contains(c, ':')) AND c RLIKE '(://|[.]{1,2}/|[A-Za-z0-9]/)[^ ]*$|https?:$' AS DOUBLE)",
    "dots": "regexp_count(t, '[.]') / length(t)",
    "uuid": "CAST(t RLIKE '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-' AS DOUBLE)",
    "prefix": f"CAST(t RLIKE '^{_PREFIX}' AS DOUBLE)",
    "asks": f"CAST(a AND l RLIKE '({_ASKS})[a-z_]*[^a-z0-9]{{0,6}}$' AS DOUBLE)",
    "asks_near": f"CAST(a AND l RLIKE '{_ASKS}' AS DOUBLE)",
    "asks_pass": f"CAST(a AND l RLIKE '({_PASS})[a-z_]*[^a-z0-9]{{0,6}}$' AS DOUBLE)",
    "user_part": "CAST(c RLIKE '://[^\\\\s/:@]*:$' AND f LIKE '@%' AS DOUBLE)",
    "others": "regexp_count(t, '[^A-Za-z0-9_+/.-]') / length(t)",
    "blanks": "CAST(regexp_count(t, '\\\\s') AS DOUBLE)",
    "code": "CAST(t RLIKE '^[$%@]?[{(<\\\\[]|[(]|^[$][A-Za-z_]+$|^[A-Za-z_]+([.][A-Za-z_]+)+|^[*.x]+$' AS DOUBLE)",
    "stock": "CAST(lower(t) RLIKE '(passw|secret|token|key|redact|hidden|masked|todo)|^(none|null|nil|true|false|undefined|string|str|text|bytes|int|required|optional|invalid|missing|expired|empty|value|default|user|admin|root|pass)$' AS DOUBLE)",
    "benign": f"CAST({_holds('n', _BENIGN)} OR contains(n, 'sha') AND n RLIKE 'sha-?[0-9]' AS DOUBLE)",
    "filler": "CAST(lower(t) RLIKE '(example|your|change|xxxx|1234|abcd|dummy|sample|test|placeholder|0000)' AS DOUBLE)",
    "set": "CAST(c RLIKE '[=:]\\\\s*[\"\\']?$' AS DOUBLE)",
}


#: How the contexts of values end in the default training set.
_ASKING = ("password", "passwd", "pwd", "passphrase", "pass_phrase", "db_pass", "token", "tokens", "secret", "secrets", "credentials", "bearer", "key", "apikey")


def labelled_findings(n: int = 4000, seed: int = 7) -> list[dict]:
    """The default training set: n findings, half of them secrets."""
    r = random.Random(seed)
    hexa, b32, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    syllables = "an er tion the re in st ou le men ra ko ti sen ber und gen lich os la que".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda k=3: " ".join(r.choice(WORDS) if r.random() < 0.3 else word() for _ in range(k)) + " "
    key = lambda: r.choice(["password", "passwd", "token", "secret", "api_key", "apikey", "access_key", "auth_token", "client_secret", "db_password", "pwd", "API_TOKEN"])
    sets = lambda: r.choice(["=", " = ", ": ", "=\"", " = \"", ": \"", " = '", "\": \""])

    marks = "!@#$%^&*?~+=-_.,:;|"
    ask = lambda: r.choice(["password", "passwd", "pwd", "PASSWORD", "db_password", "Password", "passphrase", "pass_phrase", "DB_PASS", "userPassword"])
    link = lambda: prose(2) + r.choice(["postgres", "mysql", "https", "amqp", "redis", "ftp", "mongodb"]) + "://" + r.choice(["admin", "root", word(), "user", ""]) + ":"

    def phrase() -> str:
        """What people take as a password: words, words with numbers and marks, or no order at all."""
        kind = r.randrange(4)
        if kind == 0:
            return (word() + word() + word() + word())[: r.randint(8, 24)]
        if kind == 1:
            return word().capitalize() + r.choice(["", *marks]) + str(r.randint(1, 9999)) + r.choice(["", *marks])
        if kind == 2:
            return r.choice([" ", "-", "."]).join(word() for _ in range(r.randint(2, 4)))
        return some(alnum + marks, r.randint(6, 24))

    def secret() -> tuple[str, str]:
        kind = r.randrange(13)
        if kind >= 11:
            return link(), r.choice([phrase().replace(" ", ""), some(alnum, r.randint(6, 24)), some(alnum + "!$%*", r.randint(8, 20))])
        if kind >= 9:
            return prose() + ask() + sets(), phrase()
        if kind <= 1:
            return prose(), "AKIA" + some(b32 if r.random() < 0.5 else b32 + "0189", 16)
        if kind == 2:
            return prose(), r.choice(["ghp_", "gho_", "sk_live_", "glpat-", "xoxb-", "AIza", "sk-", "rk_live_"]) + some(alnum, r.randint(20, 40))
        if kind <= 5:
            return prose() + key() + sets(), some(hexa, r.choice([16, 18, 20, 24, 32, 40, 64]))
        if kind <= 7:
            return prose() + key() + sets(), some(alnum + r.choice(["", "+/", "_-"]), r.randint(14, 64))
        return prose() + r.choice(["Authorization: Bearer ", "bearer ", "auth: "]), "eyJ" + some(alnum, r.randint(30, 80)) + "." + some(alnum, r.randint(30, 80))

    def other() -> tuple[str, str]:
        kind = r.randrange(19)
        if kind == 13:
            return prose(), r.choice(["", "-", "_", "."]).join(word() for _ in range(r.randint(2, 5)))
        if kind == 14:
            return prose() + r.choice([key(), ask()]) + sets(), r.choice(["none", "null", "true", "false", "undefined", "string", "str", "required", "optional", "password", "your_password", "secret", "token", "hidden", "********", "xxxxxx", "[REDACTED]", "example", "changeme", "invalid", "expired", "default"])
        if kind == 15:
            return prose() + r.choice([key(), ask()]) + sets(), r.choice(["${%s}", "$%s", "{{ %s }}", "<%s>", "os.environ[%s]", "get_%s()", "self.%s", "request.%s", "config.%s.value", "%s(user)", "process.env.%s"]) % r.choice([key(), ask(), word()])
        if kind == 16:
            return prose() + r.choice(["the ", "a ", ""]) + r.choice(["password ", "secret ", "token ", "tokens ", "credentials ", "secrets ", "bearer "]), r.choice(["must", "is", "for", "of", "and", "to", "field", word(), word(), r.choice(WORDS), word() + word()])
        if kind == 17:
            return prose() + r.choice([key(), ask()]) + sets(), prose(r.randint(5, 14)).strip() + r.choice(["", ".", "!"])
        if kind == 18:
            return link(), r.choice(["password", "pass", "${PASSWORD}", "$PASSWORD", "<password>", "secret", "your_password", "xxxx", "****", "8080", "5432"])
        if kind == 0:
            return prose() + r.choice(["commit ", "sha256:", "md5 ", "checksum: ", "sha1=", "digest ", "revision ", "hash: "]), some(hexa, r.choice([32, 40, 64]))
        if kind == 1:
            return prose(2) + r.choice(["id ", "uuid ", "", "guid="]), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))
        if kind == 2:
            return prose(2) + r.choice(["https:", "http:"]), "//" + word() + ".com/" + word() + "/" + some(hexa + "0123456789", r.randint(6, 30))
        if kind == 3:
            return prose(), r.choice(["./", "/usr/lib/", "src/", "assets/", "/var/log/"]) + word() + "/" + word() + str(r.randint(1, 9999)) + r.choice([".js", ".png", ".py", ".log"])
        if kind == 4:
            return prose(2) + key() + sets(), r.choice(["changeme", "your_api_key_here", "example", "dummypass", "placeholder", "xxxxxxxxxx", "test"]) + r.choice(["1234", "123", "0000", "2024", "12345678"])
        if kind == 5:
            return prose() + r.choice(["", "card ", "order ", "invoice "]), some("0123456789", r.randint(10, 19))
        if kind == 6:
            return prose() + r.choice(["+1 (", "phone ", ""]), some("0123456789", 3) + "-" + some("0123456789", 7)
        if kind == 7:
            return prose(), ".".join(str(r.randint(10, 255)) for _ in range(4)) + r.choice(["", "", ".local"])
        if kind == 8:
            return prose(), word() + word() + word() + str(r.randint(1, 99)) + r.choice(["", word()])
        if kind == 9:
            return prose() + r.choice(["version ", "v", "build "]), f"{r.randint(1, 30)}.{r.randint(0, 30)}.{r.randint(0, 300)}-{r.choice(['beta', 'rc', 'alpha'])}.{r.randint(1, 99)}"
        if kind == 10:
            return prose() + "data:image/png;base64,", some(alnum + "+/", r.randint(30, 90))
        if kind == 11:
            return prose() + r.choice(["", "at ", "on "]), f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}"
        return prose(), r.choice(WORDS).capitalize() + r.choice(WORDS).capitalize() + word().capitalize() + str(r.randint(1, 2030))

    out = []
    while len(out) < n:
        label = len(out) % 2
        context, piece = secret() if label else other()
        user = context.endswith(":") and "://" in context and not piece.startswith("//")
        if len(piece) >= 10 or user or context.rstrip(" =:\"'").lower().endswith(_ASKING):
            out.append({"context": context[-60:], "piece": piece, "follow": "@" * user + prose(2), "label": label})
    return out


def _forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int = 11) -> list:
    """Trees on bootstrap samples; each node tries a random third of the features.  A leaf is a share, a node (feature, cut, left, right)."""
    rng = np.random.default_rng(seed)
    tries = max(2, x.shape[1] // 3)

    def grow(rows: np.ndarray, left: int):
        share = float(y[rows].mean())
        if left == 0 or len(rows) < 2 * LEAST_LEAF or share in (0.0, 1.0):
            return share
        best = None
        for j in rng.choice(x.shape[1], tries, replace=False):
            v = x[rows, j]
            order = np.argsort(v, kind="stable")
            s, t = v[order], np.cumsum(y[rows][order])
            at = np.flatnonzero(s[1:] > s[:-1]) + 1
            at = at[(at >= LEAST_LEAF) & (at <= len(s) - LEAST_LEAF)]
            if len(at):
                a, total = t[at - 1], t[-1]
                p, q = a / at, (total - a) / (len(s) - at)
                impurity = at * p * (1 - p) + (len(s) - at) * q * (1 - q)
                i = int(np.argmin(impurity))
                if best is None or impurity[i] < best[0]:
                    best = (impurity[i], int(j), float((s[at[i] - 1] + s[at[i]]) / 2))
        if best is None:
            return share
        _, j, cut = best
        low = x[rows, j] <= cut
        return (j, cut, grow(rows[low], left - 1), grow(rows[~low], left - 1))

    return [grow(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def _tree_sql(node, names: list[str]) -> str:
    if isinstance(node, float):
        return f"{node:.6f}D"
    j, cut, low, high = node
    return f"CASE WHEN x.{names[j]} <= {cut:.9f}D THEN {_tree_sql(low, names)} ELSE {_tree_sql(high, names)} END"


def _features_sql(t: str, c: str, f: str) -> str:
    """named_struct of all features; what they are made of is bound once, each by a lambda over an array of one."""
    out = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in FEATURES.items()) + ")"
    for name, value in (("a", _holds("l", _SIGNS)), ("n", "concat(l, ' ', lower(f))"), ("l", "lower(c)"), ("f", f), ("c", c), ("t", t)):
        out = f"element_at(transform(array({value}), {name} -> {out}), 1)"
    return out


def train(spark: SparkSession, findings: DataFrame | None = None) -> str:
    """The forest as SQL over a struct ``x`` of features: the mean of its trees' shares."""
    if findings is None:
        rows = json.dumps(labelled_findings()).replace("\\", "\\\\").replace("'", "\\'")
        findings = spark.sql(f"SELECT inline(from_json('{rows}', 'array<struct<context: string, piece: string, follow: string, label: int>>'))")
    has(findings, "context", "piece", "follow", "label")
    named = findings.select("context", "piece", "follow", "label").where("length(piece) > 0 AND label IS NOT NULL")
    named = named.orderBy(F.xxhash64("context", "piece", "follow"), "context", "piece", "follow", "label").limit(MAX_FINDINGS)
    names = list(FEATURES)
    rows = named.select("label", F.expr(_features_sql("piece", "coalesce(context, '')", "coalesce(follow, '')")).alias("x")).collect()
    if not rows:
        raise ValueError("no labelled findings")
    x = np.array([[float(r["x"][k]) for k in names] for r in rows])
    y = np.array([float(r["label"]) for r in rows])
    return "(" + " + ".join(_tree_sql(t, names) for t in _forest(x, y, TREES, DEPTH)) + f") / {TREES}"


def findings(docs: DataFrame, *, text: str = "text", model: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``row``, ``text``, ``pieces`` and arrays along them: ``within`` (number of a piece in its value), ``scored`` (candidates that begin there: n pieces of a value, or the run within the piece if n is 0; score), ``whole`` and ``run`` (whether these are secrets).

    All arrays are as long as ``pieces``, and a piece looks at its own place and
    a few before and after it, so the work grows with the text alone, however
    many findings it has.
    """
    model = model or train(docs.sparkSession)
    v = f"'{_sql(_VALUE)}'"
    df = packed(docs, text).withColumn("asked", F.expr(f"CASE WHEN text IS NULL THEN NULL WHEN {_holds('lower(text)', _SIGNS)} THEN regexp_extract_all(text, {v}, 0) ELSE CAST(array() AS array<string>) END"))
    df = df.withColumn("between", F.expr(f"if(size(asked) > 0, split(text, {v}, -1), array(text))"))
    df = df.withColumn("heads", F.expr(f"if(size(asked) > 0, zip_with(regexp_extract_all(text, {v}, 1), regexp_extract_all(text, {v}, 2), (a, b) -> concat(a, b)), asked)"))
    cut = lambda t: f"flatten(transform(regexp_extract_all({t}, '{_PIECE}', 0), p -> if(p RLIKE '{_RUN}', split(p, '{_CUT}', -1), array(p))))"
    # By turns what leads to a value and the value, each in pieces.  Every array that a lambda below looks into is a column read more than once: Spark would inline others and build them anew for each piece.
    parted = f"flatten(transform(between, (g, i) -> if(i < size(asked), array({cut('concat(g, heads[i])')}, {cut('substring(asked[i], length(heads[i]) + 1)')}), array({cut('g')}))))"
    df = df.withColumn("parts", F.expr(f"if(text IS NULL, NULL, {parted})")).withColumn("pieces", F.expr("flatten(parts)"))
    along = lambda value, other: F.expr(f"flatten(transform(parts, (q, j) -> if(j % 2 = 1, transform(q, (x, k) -> {value}), array_repeat({other}, size(q)))))")
    df = df.withColumn("within", along("k", "0")).withColumn("spans", along("if(k = 0, size(q), 0)", "0")).withColumn("values", along("if(k = 0, array_join(q, ''), '')", "''"))
    both = f"array(named_struct('n', spans[i], 't', values[i]), named_struct('n', 0, 't', if(length(p) >= 10, regexp_extract(p, '{_KEY}', 0), '')))"
    once = f"filter({both}, s -> s.t <> '' AND NOT (s.n = 0 AND spans[i] = 1 AND s.t = p))"
    df = df.withColumn("tails", F.expr(f"transform(pieces, p -> right(p, {BEFORE}))")).withColumn("starts", F.expr(f"transform(pieces, p -> left(p, {AFTER}))"))
    c = "right(concat_ws('', " + ", ".join(f"get(tails, i - {k})" for k in range(6, 0, -1)) + f"), {BEFORE})"
    f = "left(concat_ws('', " + ", ".join(f"get(starts, i + greatest(s.n, 1) + {k})" for k in range(3)) + f"), {AFTER})"
    scored = f"transform({once}, s -> named_struct('n', s.n, 'score', element_at(transform(array({_features_sql('s.t', c, f)}), x -> {model}), 1)))"
    none = "CAST(array() AS array<struct<n: int, score: double>>)"
    df = df.withColumn("scored", F.expr(f"transform(pieces, (p, i) -> if(spans[i] > 0 OR p RLIKE '{_RUN}', {scored}, {none}))"))
    df = df.withColumn("whole", F.expr(f"transform(scored, a -> exists(a, s -> s.n > 0 AND s.score >= {threshold}))"))
    return df.withColumn("run", F.expr(f"transform(scored, (a, i) -> exists(a, s -> s.n = 0 AND s.score >= {threshold}) AND NOT whole[i - within[i]])"))


def _sql(pattern: str) -> str:
    """For an ordinary SQL string literal: quotes escaped (backslashes are doubled in the constants)."""
    return pattern.replace("'", "\\'")


def _redacted() -> F.Column:
    cleaned = f"array_join(transform(pieces, (p, i) -> CASE WHEN whole[i] THEN '{MARK}' WHEN within[i] > 0 AND whole[i - within[i]] THEN '' WHEN run[i] THEN regexp_replace(p, '{_KEY}', '{MARK}') ELSE p END), '')"
    return F.expr(f"CASE WHEN exists(whole, h -> h) OR exists(run, h -> h) THEN {cleaned} ELSE text END")


def redacted(docs: DataFrame, *, text: str = "text", model: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]``, columns unchanged."""
    df = findings(docs, text=text, model=model, threshold=threshold).withColumn("text", _redacted())
    return unpacked(df, docs.columns, text)


def report(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", model: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_candidates, n_secrets, max_score (of all candidates; null without any), secrets_at (character offsets from 0), redacted_sha256."""
    has(docs, id_col, text)
    df = findings(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), model=model, threshold=threshold)
    # One running sum over the pieces: where each begins; the places of secrets are written down as it passes.
    start = f"s.at + if(whole[i], 0, regexp_instr(pieces[i], '{_KEY}') - 1)"
    places = f"aggregate(sequence(0, size(pieces) - 1), named_struct('at', 0L, 'said', ''), (s, i) -> named_struct('at', s.at + length(pieces[i]), 'said', if(whole[i] OR run[i], concat(s.said, ',', {start}), s.said)), s -> substring(s.said, 2))"
    count = lambda e: F.coalesce(F.expr(e), F.lit(0)).cast("bigint")
    return df.select(
        F.col("row.id").alias("doc_id"), count("aggregate(scored, 0, (s, a) -> s + size(a))").alias("n_candidates"),
        count("size(filter(whole, h -> h)) + size(filter(run, h -> h))").alias("n_secrets"),
        F.expr("array_max(transform(flatten(scored), s -> s.score))").alias("max_score"),
        F.expr(f"if(exists(whole, h -> h) OR exists(run, h -> h), {places}, '')").alias("secrets_at"),
        F.sha2(F.coalesce(_redacted(), F.lit("")), 256).alias("redacted_sha256"),
    )


def op8(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"))
