"""evidence_snippets and its SQL over texts in which regular expressions of Java and of RE2 read words, blanks and case differently."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry

TEXTS = [
    "hace 12 años. nada", "il y a 5 à 7 pièces. rien", "é5 a. x", "Rated 10 aé and 7 A here", "çurrent 3 ampé 4 amps", "Voltage 120 vé or 240 v", "voltage ñ9 v 8 kv",
    "á12 a here", "120 v́ voltage 9 v", "5² a done", "voltage 12 Kv and 13 kV", "current 5 ampſ 6 amps", "DİMENSİON of it", "BUİLT-IN",
    "\x0bdepth of it\x0b", "5\x0ba done", "voltage 7\x0bv", "\x0b\x0ba", "width\x0b\n\x0b\x0bdiameter 3", "\x85depth\xa0", "  material x　", "current_5 a 6 a", "12 a current", None, "", "\n",
]


def test_snippets_are_those_of_the_sql(spark, sf, tmp_path):
    names = "region nation customer supplier part orders lineitem events embeddings benchmark labels conversations".split()
    for name in names:
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    ids = list(range(len(TEXTS)))
    pq.write_table(pa.table({"doc_id": ids, "text": TEXTS}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"page_id": ids, "url": ["u"] * len(ids), "html": [f"<p>{t or ''}</p>" for t in TEXTS]}), tmp_path / "pages.parquet")
    con = duckdb.connect()
    for name in [*names, "documents", "pages"]:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    columns = ["source", "id", "spec_key", "value", "evidence"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()['evidence_snippets']})").fetchall()
    got = [tuple(r) for r in entry.queries()["evidence_snippets"](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(got) == sorted(want)
    assert ("document", 3, "amperage", "7 A", "Rated 10 aé and 7 A here") in got and not any(r[1] == 0 and r[0] != "evidence" for r in got)
