"""A PySpark-native engine for typed scoring documents and their function library."""


def __getattr__(name):
    if name in ("Engine", "chain", "engine", "engine_from_yaml"):
        from .plans import compiler

        return getattr(compiler, name)
    raise AttributeError(name)
