"""The pipeline's last stage encodes and decodes."""

from hashlib import sha256

import public_tokenizers
from test_text_operators import CASES
from tokenizers import Tokenizer

import corpus_pipeline


def test_last_stage_decodes(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.createDataFrame(list(enumerate([*CASES, None])), "doc_id long, text string")
    found = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
    for i, t in enumerate([*CASES, ""]):
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(found[i]["ids"]) == ids and found[i]["n_tokens"] == len(ids)
        assert found[i]["decoded_sha256"] == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
