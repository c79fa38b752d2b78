"""Sweep files are opened once."""

from thermoscope.sources import files as fs


def test_lines_are_stored_before_they_are_parsed(spark, scratch, monkeypatch):
    import os
    os.makedirs(f"{scratch}/s")
    for i in range(3):
        with open(f"{scratch}/s/{i}.csv", "w") as out:
            out.write("Frequency(Hz),Return Loss(dB),Phase(deg),Xs\n1,2,3,4\n5,6,7,%d\n" % i)
    read, parse = [], fs.parse_sweep_lines

    def kept(lines):
        read.extend(lines.inputFiles())
        return parse(lines)

    monkeypatch.setattr(fs, "parse_sweep_lines", kept)
    got = fs.read_sweeps(spark, [f"{scratch}/s"]).select("file", "point_idx", "xs").collect()
    assert sorted(map(tuple, got)) == sorted((f"{i}.csv", p, float(i if p else 4)) for i in range(3) for p in (0, 1))
    assert read and not [f for f in read if f.endswith(".csv")]


def test_sweeps_of_equal_ids_and_few_folders(spark, scratch, monkeypatch):
    """A folder for each vector cost the time of the round trip; rows of equal id shared one file with two headers."""
    import os

    import duckdb
    import pandas as pd

    import __spark_entry__ as entry
    from thermoscope.sources.tables import load
    e = load(spark, "/root/testdata/sf0.001", "embeddings").limit(40).toPandas()
    e = pd.concat([e, e.iloc[:3].assign(embedding=e.embedding.iloc[5:8].tolist()), e.iloc[[1]]])
    e.to_parquet(os.path.join(scratch, "embeddings.parquet"), index=False)
    roots, write = [], fs.write_sweeps
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{scratch}/embeddings.parquet')")
    want = sorted(con.execute(entry.oracle_sql()["s2_sweep_files_round_trip"]).fetchall())
    monkeypatch.setattr(fs, "FOLDERS", 5)
    # a mounted folder, and one that only Spark's writer knows
    for change in (lambda r: r, lambda r: r.replace("file:", "", 1)):
        def kept(texts, root):
            roots.append(root)
            return write(texts, change(root))
        monkeypatch.setattr(fs, "write_sweeps", kept)
        got = entry.queries()["s2_sweep_files_round_trip"](spark, scratch)
        assert sorted(map(tuple, got.select("vec_id", "point_idx", "freq_hz", "return_loss_db", "phase_deg", "xs").collect())) == want
    mounted = "/" + roots[0].split(":", 1)[1].lstrip("/")
    assert len(os.listdir(mounted)) == 5
    assert sum(len(names) for _, _, names in os.walk(mounted)) == len(e)


def test_many_small_files_share_a_task(spark, scratch, monkeypatch):
    import os
    os.makedirs(f"{scratch}/s")
    for i in range(300):
        with open(f"{scratch}/s/{i}.csv", "w") as out:
            out.write("Frequency(Hz),Return Loss(dB),Phase(deg),Xs\n1,2,3,%d\n" % i)
    parts, parse = [], fs.parse_sweep_lines

    def kept(lines):
        parts.append(len(lines.inputFiles()))
        return parse(lines)

    monkeypatch.setattr(fs, "parse_sweep_lines", kept)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")   # four files a task at 4 MB each
    try:
        assert fs.read_sweeps(spark, [f"{scratch}/s"]).count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    assert parts[0] <= 8 and spark.conf.get("spark.sql.files.openCostInBytes") == before[1]


def test_line_numbers_across_blocks(spark, scratch):
    """Files that several tasks read in part, with blank lines and a blank or late header."""
    import os
    os.makedirs(f"{scratch}/s")
    head = "Frequency(Hz),Return Loss(dB),Phase(deg),Xs"
    for name, first in (("a", head), ("b", "")):
        with open(f"{scratch}/s/{name}.csv", "w") as out:
            out.write(first + "\n" + "".join(f"{i},2,3,4\n" + "\n" * (i % 3) for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = fs.read_sweeps(spark, [f"{scratch}/s"])
        rows = got.select("file", "point_idx", "freq_hz").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["point_idx"] for r in rows if r["file"] == "b.csv") == list(range(2000))
    assert sorted((r["point_idx"], r["freq_hz"]) for r in rows if r["file"] == "a.csv") == [(i, float(i)) for i in range(2000)]
