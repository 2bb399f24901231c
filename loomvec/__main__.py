"""python -m loomvec QUERY DOCUMENT [--model ID]: the late-interaction score of two texts."""

import argparse

from loomvec.api import MultiVectorEmbedder
from loomvec.session import get_session


def main() -> None:
    args = argparse.ArgumentParser(prog="loomvec", description=__doc__)
    args.add_argument("query")
    args.add_argument("document")
    args.add_argument("--model", default="colbert-v2")
    given = args.parse_args()
    model = MultiVectorEmbedder.new(given.model)
    spark = get_session("loomvec-cli", 1, 1)
    pair = spark.createDataFrame([(given.query, given.document)], "q string, d string")
    scored = model.encode(model.encode(pair, "q", "qv"), "d", "dv").select(model.similarity("qv", "dv").alias("score"))
    print(f"{scored.first().score:.4f}")
    spark.stop()


if __name__ == "__main__":
    main()
