import base64
import random

import duckdb
import pytest
import tiktoken
from tokenizers import Tokenizer

from symvane.llm import encode as mod
from symvane.llm.encode import PATTERN, VOCABULARY, Encoder, encode

TEXTS = [x for (x,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard(seed):
    r = random.Random(seed)
    pool = "aab  \n\t\r\x0b\x1c\x1dabcé世界 👩‍💻'sT<|endoftext|>0123--__​\xa0　ไทยกा"
    return ["".join(r.choice(pool) for _ in range(r.randrange(1, 120))) for _ in range(300)]


def test_equals_two_public_libraries(reference):
    texts = TEXTS + hard(1) + ["", None, "a" * 20_000, "ab" * 3_000, " " * 5_000, "<|endoftext|>"]
    got = Encoder().encode_batch(texts)
    assert got == [reference.encode_ordinary(t) if t else [] for t in texts]
    other = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    assert got == [e.ids for e in other.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_memory_limit_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(mod, "MEMORY", 50)
    monkeypatch.setattr(mod, "MEMORY_BYTES", 5)
    e = Encoder()
    for t in TEXTS[:40]:
        assert e.encode_batch([t, t]) == [reference.encode_ordinary(t) if t else []] * 2


def test_frame(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", "x"), (None, "a", None)], "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), r.ids) for r in encode(df, "doc_id", "text").collect())
    assert got == [("1", [15496, 995]), ("1", [15496, 995]), ("2", []), ("3", []), ("None", [64])]
    assert encode(df.limit(0), "doc_id", "text").collect() == []
