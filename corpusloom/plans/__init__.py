from . import evidence, gates, rules, views  # noqa: F401  they add their queries to those of `queries`
