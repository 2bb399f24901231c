"""Token ids by a public tokenizer file."""

import pytest

from loomvec.errors import TokenizationError
from loomvec.functions import sequences, tokenizer

FILE = "/opt/tokenizers/byte_bpe_50k.json"


def test_ids_and_back(spark):
    texts = spark.createDataFrame([(1, "machine learning"), (2, "learning machines learn"), (3, None), (4, "")], "id int, text string")
    found = tokenizer.encode(texts, FILE, add_special_tokens=False)
    rows = {r.id: r for r in tokenizer.decode(found, FILE).collect()}
    assert rows[1].decoded == "machine learning" and rows[3].decoded is None and rows[4].token_ids == []
    assert rows[3].token_ids is None and rows[3].attention_mask is None and rows[1].attention_mask == [1] * len(rows[1].token_ids)
    padded = {r.id: r.token_ids for r in sequences.pad_sequences(found.where("text is not null").selectExpr("*", "0 as batch"), "token_ids", "batch", 7).collect()}
    assert len(set(map(len, padded.values()))) == 1 and padded[4] == [7] * len(padded[2])
    assert tokenizer.vocab_size(FILE) == 50257
    assert tokenizer.encode(texts.where("false"), FILE).count() == 0


def test_missing_file():
    with pytest.raises(TokenizationError):
        tokenizer.opened("/nowhere.json")
