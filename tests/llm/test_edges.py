"""Every query of this subpackage on tables of nulls, empty and long texts, repeated rows and clashing columns, and on empty tables."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

L, S, F4 = pa.int64(), pa.string(), pa.list_(pa.float32())
TEXTS = [None, "", " \n\t ", "a", "wörd lorem, IPSUM dolor.\n" * 20_000, *["same text here again " * 10] * 3, "x" * 100_000, " " * 50_000 + "y", "\x00\x1f bad 　 sep", "idiot scum " * 30]
ROWS = {"op1": 4, "op2": 4, "op3": 12, "op4": 4, "op5": 12, "op7": 6, "op8": 12, "op9": 12, "op10": 12}


def write(folder, empty):
    n = len(TEXTS)
    tables = {
        "documents": {
            "doc_id": ([0, 1, 2, 3, 4, 5, 6, 6, 8, 9, None, -11], L), "text": (TEXTS, S), "lang": ([None] * n, S), "source": (["s"] * 5 + [None] * 3 + ["t"] * 4, S), "n_chars": ([None] * n, L),
            "n_words": (["clash"] * n, S), "n": ([1.5] * n, pa.float64()), "score": (["z"] * n, S), "spans": ([None] * n, S), "p_toxic": ([9] * n, L),
        },
        "labels": {"doc_id": ([0, 1, None, 5, 6, 6, -11], L), "quality": ([1, None, 1, 0, 1, 0, 1], pa.int32()), "toxic": ([0, 0, 1, None, 0, 0, 1], pa.int32())},
        "embeddings": {"vec_id": ([0, 50, 100, None, 7, 7, 8, 9], L), "embedding": ([[1.0] * 64, [1.0] * 63 + [0.5], None, [1.0] * 64, [0.0] * 64, [2.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63], F4)},
        "pages": {"page_id": ([0, 1, 2, 2, None, 5], L), "url": (["http://a b", None, "", "http://x", "u", "é"], S), "html": ([None, "", *["<p>" * 100] * 3, "é" * 90_000], S), "payload": ([None] * 6, S)},
        "conversations": {"conv_id": ([1, 1, 1, None, 2, 2], L), "turn": ([0, 1, 1, None, 0, 0], L), "role": (["user", "assistant", "assistant", None, "user", "user"], S), "text": ([None, "### x", "### x", None, "", ""], S), "seq": ([1] * 6, L)},
    }
    for name, columns in tables.items():
        t = pa.table({k: pa.array(v, kind) for k, (v, kind) in columns.items()})
        pq.write_table(t.slice(0, 0) if empty else t, f"{folder}/{name}.parquet")


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_odd_and_empty_tables(spark, tmp_path, name):
    for empty in (False, True):
        folder = tmp_path / str(empty)
        folder.mkdir()
        write(folder, empty)
        rows = entry.queries()[name](spark, str(folder)).collect()
        if empty:
            assert len(rows) == (1 if name.startswith("op2_") else 0)  # the conversation that is always there
        else:
            assert len(rows) == ROWS.get(name.split("_")[0], len(rows)) and rows
