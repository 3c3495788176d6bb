"""Registered queries: those with a SQL twin return the same rows, all have the agreed columns."""

import duckdb
import pytest

from brierworks.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()

COLUMNS = {
    "op1_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op4_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op5_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op6_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_conversation_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op13_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.dtypes) == sorted(tuple(c.split()) for c in COLUMNS[name].split(", "))
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        names = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(want, key=str)
    else:
        assert df.count() > 0


def test_every_operator_has_a_query():
    assert set(queries.QUERIES) == set(COLUMNS)
