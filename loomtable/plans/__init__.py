"""Configuration, pipelines, the fluent interface and the command line."""
