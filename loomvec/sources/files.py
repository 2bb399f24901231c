"""Files: images, pages, weights and NumPy arrays."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.errors import ModelLoadError, SourceError

MEAN = (0.48145466, 0.4578275, 0.40821073)
DEVIATION = (0.26862954, 0.2613026, 0.2757771)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path and content of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_pages(spark: SparkSession, path: str, render: Callable[[bytes], Iterator[bytes]]) -> DataFrame:
    """path, page (from 0) and image of multi-page files. `render` yields the pages of one file's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for page, image in enumerate(render(content)):
                    yield pa.RecordBatch.from_pydict({"path": [name], "page": pa.array([page], pa.int32()), "image": [image]})

    return read_images(spark, path).mapInArrow(run, "path string, page int, image binary")


def normalize_pixels(pixels: DataFrame, channel: str = "channel", value: str = "p", out: str = "v", mean: tuple[float, ...] = MEAN, deviation: tuple[float, ...] = DEVIATION) -> DataFrame:
    """(p / 255 - mean) / deviation for rows of single pixels; channels count from 0."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col(channel) + 1).cast("int"))
    return pixels.withColumn(out, (F.col(value) / 255.0 - pick(mean)) / pick(deviation))


def image_tensor(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """image, pixels: all channels one after another, each row by row."""
    normal = normalize_pixels(pixels)
    return normal.groupBy(image).agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "y", "x", "v"))), lambda s: s["v"]).alias("pixels"))


def cubic_weights(n_in: int, n_out: int) -> np.ndarray:
    """The n_out by n_in matrix of Catmull-Rom interpolation; shrinking widens the kernel."""
    ratio = n_in / n_out
    support = max(1.0, ratio)
    centre = (np.arange(n_out) + 0.5) * ratio
    t = np.abs((np.arange(n_in)[None, :] + 0.5 - centre[:, None]) / support)
    w = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image (height, width, channels) of bytes in another size."""
    out = np.einsum("ab,bcd,ec->aed", cubic_weights(image.shape[0], height), image.astype(np.float64), cubic_weights(image.shape[1], width))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def preprocess(images: DataFrame, decode: Callable[[bytes], np.ndarray], size: int = 448, content: str = "content") -> DataFrame:
    """path and pixels: decoded (`decode` gives height, width, 3 of bytes), resized, normalised, channels first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = resize(decode(data), size, size) / 255.0
                tensor = ((image - np.array(MEAN)) / np.array(DEVIATION)).transpose(2, 0, 1)
                yield pa.RecordBatch.from_pydict({"path": [name], "pixels": pa.array([tensor.ravel()], pa.list_(pa.float64()))})

    return images.select("path", content).mapInArrow(run, "path string, pixels array<double>")


def patch_count(image_size: Column | int, patch_size: Column | int):
    """Patches of a square image."""
    if isinstance(image_size, int) and isinstance(patch_size, int):
        return (image_size // patch_size) ** 2
    n = F.floor((F.lit(image_size) if isinstance(image_size, int) else image_size) / (F.lit(patch_size) if isinstance(patch_size, int) else patch_size))
    return n * n


def shard_names(index: Column | str) -> Column:
    """The distinct file names, in order, of a weight map's JSON."""
    index = F.col(index) if isinstance(index, str) else index
    return F.array_sort(F.array_distinct(F.map_values(F.from_json(index, "struct<weight_map:map<string,string>>")["weight_map"])))


def read_safetensors(path: str) -> dict[str, np.ndarray]:
    """All tensors of a file, mapped into memory rather than read."""
    kinds = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}
    try:
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            header = json.loads(f.read(size))
    except (OSError, ValueError) as e:
        raise ModelLoadError(path, e) from e
    data = np.memmap(path, mode="r", offset=8 + size)
    out = {}
    for name, t in header.items():
        if name == "__metadata__":
            continue
        if t["dtype"] not in kinds:
            raise ModelLoadError(path, f"type {t['dtype']} of {name} isn't supported")
        a, b = t["data_offsets"]
        out[name] = data[a:b].view(kinds[t["dtype"]]).reshape(t["shape"])
        if t["dtype"] == "BF16":  # the upper half of a float32
            out[name] = (out[name].astype(np.uint32) << 16).view(np.float32)
    return out


def from_numpy(spark: SparkSession, vectors: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each row of a matrix, numbered from 0."""
    lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(vectors, dtype=np.float32).ravel()), vectors.shape[1])
    return spark.createDataFrame(pa.table({id_col: np.arange(len(vectors)), vector_col: lists.cast(pa.list_(pa.float32()))}))


def to_numpy(df: DataFrame, vector_col: str = "embedding") -> np.ndarray:
    """The vectors of a result as a matrix on the driver."""
    column = df.select(vector_col).toArrow()[vector_col].combine_chunks()
    if not len(column):
        return np.zeros((0, 0), dtype=np.float32)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def local_file(folder: str, name: str) -> Path:
    """A model's file in a folder that the user has filled; nothing is downloaded."""
    path = Path(folder) / name
    if not path.is_file():
        raise SourceError(f"IO error: {path} doesn't exist")
    return path


#: Names of networks by a part of the model type that a configuration states, in order, for each kind of encoder.
FAMILIES = {
    "dense": (("distilbert", "distilbert"), ("jina", "jinabert"), ("xlm%roberta", "xlm-roberta"), ("modernbert", "modernbert"), ("bert", "bert")),
    "multi": (("distilbert", "distilbert"), ("jina", "jinabert"), ("bert", "bert")),
    "sparse": (("distilbert", "distilbert"), ("bert", "bert")),
}


def model_family(config: Column | str, kind: str = "dense") -> Column:
    """The kind of network that a model's JSON configuration names, or else that its sizes
    tell: `dim` without `hidden_size` is distilbert, `hidden_size` bert. Null where neither does."""
    config = F.col(config) if isinstance(config, str) else config
    stated = F.lower(F.get_json_object(config, "$.model_type"))
    out = F.when(F.lower(F.get_json_object(config, "$.architectures")).contains("jinabert"), "jinabert") if kind == "dense" else F.when(F.lit(False), "")
    for part, family in FAMILIES[kind]:
        out = out.when(stated.like(f"%{part}%"), family)
    hidden = F.get_json_object(config, "$.hidden_size").isNotNull()
    return out.when(F.get_json_object(config, "$.dim").isNotNull() & ~hidden, "distilbert").when(hidden, "bert")
