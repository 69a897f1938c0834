from quiver.functions import vectors, text  # noqa: F401
