"""The corpus queries over whole small tables: their columns, and results against brute force."""

import hashlib
import os

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from voxelframe.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
COLUMNS = {
    "op2_jaccard_join": "doc_id long, n_shingles long, component_id long",
    "op3_lattice_score": "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    "op4_nearest": "query_id long, rank int, vec_id long, score double",
    "op5_sentencepiece": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    "op6_toxicity": "doc_id long, held_out boolean, score double, predicted int",
    "op7_chat_format": "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    "op9_sharding": "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    from pyspark.sql.types import _parse_datatype_string

    df = queries.QUERIES[name](spark, SF)
    want = _parse_datatype_string(COLUMNS[name])
    assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in want.fields]


def test_sentencepiece_is_the_librarys(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nearest_recall(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    found: dict[int, set] = {}
    for r in queries.op4_nearest(spark, SF).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert abs(r["score"] - rows[r["query_id"]] @ rows[r["vec_id"]]) < 1e-12
    asked = [q for q in rows if q % 20 == 0]
    best = {q: set(sorted((i for i in rows if i != q), key=lambda i: (-(rows[q] @ rows[i]), i))[:20]) for q in asked}
    assert set(found) == set(asked) and all(len(found[q]) == 20 for q in asked)
    assert sum(len(found[q] & best[q]) for q in asked) >= 0.9 * 20 * len(asked)


def test_benchmark_passages_are_found(spark):
    from voxelframe.llm import decontam

    items = {r["item_id"]: decontam.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: decontam.normal(r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    exact = {(d, i) for d, t in texts.items() for i, b in items.items() if b in t}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontamination(spark, SF).collect()}
    assert exact <= found and len(found) <= len(exact) + 2
