"""Errors of the embedding API; each is also the built-in kind that callers expect."""


class LoomError(Exception):
    """Base of all."""


class ModelNotFound(LoomError, RuntimeError):
    def __init__(self, model_id: str):
        super().__init__(f"Model '{model_id}' not found in registry")


class ModelLoadError(LoomError, RuntimeError):
    def __init__(self, model_id: str, cause: object):
        super().__init__(f"Failed to load model '{model_id}': {cause}")


class EncodingError(LoomError, RuntimeError):
    def __init__(self, context: str):
        super().__init__(f"Encoding failed: {context}")


class UnsupportedDimension(LoomError, ValueError):
    def __init__(self, model_id: str, requested: int, supported: list[int]):
        super().__init__(f"Unsupported dimension {requested} for model '{model_id}'. Supported: {supported}")


class DeviceError(LoomError, RuntimeError):
    pass


class QuantizationError(LoomError, ValueError):
    def __init__(self, what: str):
        super().__init__(f"Quantization error: {what}")


class TokenizationError(LoomError, RuntimeError):
    pass


class ConfigError(LoomError, ValueError):
    def __init__(self, what: str):
        super().__init__(f"Invalid configuration: {what}")


class DimensionMismatch(LoomError, ValueError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"Dimension mismatch: expected {expected}, got {actual}")


class MatryoshkaError(LoomError, ValueError):
    def __init__(self, what: str):
        super().__init__(f"Matryoshka truncation error: {what}")


class SourceError(LoomError, OSError):
    """Files that can't be read."""


class TensorError(LoomError, RuntimeError):
    pass
