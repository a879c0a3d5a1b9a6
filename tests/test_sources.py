"""Files in and out, names, links, scoring, and the registry."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldstate import schema as S
from fieldstate.functions import names as N
from fieldstate.operators import parsing, scoring, series
from fieldstate.plans import catalog
from fieldstate.sources import manifests, tables
from oracle import QUERIES as SQL


def test_read_skip_header_over_a_folder(spark, tmp_path):
    schema = "date DATE, year INT, midday_filename STRING, smooth_gcc_90 DOUBLE"
    from pyspark.sql.types import _parse_datatype_string

    for site, columns in (("a", "date,year,midday_filename,smooth_gcc_90"), ("b", "year,date,extra,smooth_gcc_90,midday_filename")):
        cells = {"date": "2020-01-02", "year": "2020", "midday_filename": f'"{site}, x.jpg"', "smooth_gcc_90": "NA" if site == "b" else "0.31", "extra": "1"}
        line = ",".join(cells[c] for c in columns.split(","))
        (tmp_path / f"{site}_1day.csv").write_text("# preamble, with comma\n" * 3 + columns + "\n" + line + "\n\n")
    df = tables.read_skip_header(spark, str(tmp_path / "*_1day.csv"), 3, _parse_datatype_string(schema))
    got = sorted((r.midday_filename, r.date, r.year, r.smooth_gcc_90, r.source.split("/")[-1]) for r in df.collect())
    assert got == [("a, x.jpg", date(2020, 1, 2), 2020, 0.31, "a_1day.csv"), ("b, x.jpg", date(2020, 1, 2), 2020, None, "b_1day.csv")]


def test_read_skip_header_over_several_splits(spark, tmp_path):
    """A file cut into many splits gives the rows of its whole text; a file of preamble only gives none."""
    from pyspark.sql.types import _parse_datatype_string

    rows = [(k, f"f{k:05}.jpg") for k in range(3000)]
    (tmp_path / "big.csv").write_bytes(b"# one\r\n# two\r\n" + b"name,n\r\n" + "".join(f"{f},{k}\r\n" for k, f in rows).encode())
    (tmp_path / "short.csv").write_text("# one\n# two\n")
    (tmp_path / "small.csv").write_text("# one\n# two\nn,name\n-1,x")
    schema = _parse_datatype_string("n INT, name STRING")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = tables.read_skip_header(spark, str(tmp_path / "*.csv"), 2, schema)
        assert spark.read.text(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 5
        got = sorted((r.n, r.name) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([*rows, (-1, "x")])


def test_csv_round_trip(spark, tmp_path):
    flat = [(f"p/{i}", f"s_2020_01_0{i}_120000.jpg", *[0.0] * 20, 1.0) for i in (1, 2)]
    df = spark.createDataFrame(flat, S.PREDICTION_CSV_SCHEMA)
    tables.write_csv_table(df, str(tmp_path / "t"))
    back = tables.read_csv_table(spark, str(tmp_path / "t"), S.PREDICTION_CSV_SCHEMA)
    assert sorted(back.collect()) == sorted(df.collect())
    assert series.from_class_columns(back).select(F.get("crop_status", F.lit(6))).first()[0] == 1.0
    tables.write_table(df.withColumn("year", F.lit(2020)), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_list_images_recursive(spark, tmp_path):
    for p in ("a/x.jpg", "a/deep/er/y.jpg", "b/z.jpg", "b/note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"0")
    got = tables.list_images(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted(r.file for r in got.collect()) == ["x.jpg", "y.jpg", "z.jpg"]
    assert got.rdd.getNumPartitions() == 2  # a folder each, listed by its task
    assert all(r.filepath.startswith("file:/") for r in got.collect())
    assert [r.file for r in tables.list_images(spark, [str(tmp_path / "b")], "*.txt").collect()] == ["note.txt"]


def test_names(spark):
    df = spark.createDataFrame([("site_2020_02_29_093015.jpg",), ("site_2020_02_30_093015.jpg",), ("odd.jpg",)], "file STRING")
    got = parsing.parse_image_file(df).collect()
    assert (got[0].phenocam_name, got[0].datetime, got[0].year, got[0].date) == ("site", datetime(2020, 2, 29, 9, 30, 15), 2020, date(2020, 2, 29))
    assert got[1].date is None and got[2].datetime is None
    row = df.limit(1).select(
        N.transition_file_name(F.lit("g/x_1day.csv")).alias("t"), N.archive_url("http://h/", F.lit("s"), F.lit(date(2020, 3, 4)), "file").alias("a"),
        N.day_label(F.lit(60)).alias("d"), N.display_label("'wheat/barley'").alias("l"), N.display_rank("'nothing'").alias("r"), N.file_date("file").alias("f"),
    ).first()
    assert (row.t, row.a) == ("g/x_1day_transition_dates.csv", "http://h/s/2020/03/site_2020_02_29_093015.jpg")
    assert (row.d, row.l, row.r, row.f) == ("Mar 01", "Wheat/Barley", None, date(2020, 2, 29))


def test_links_and_audit(spark):
    html = '<A class=x HREF="/data/archive/s/1.jpg">a</a><a href=\'/data/archive/s/2.jpeg\'>b</a><a href="/data/archive/s/3.txt">c</a><a href="/other/4.jpg">d</a>'
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id INT, html STRING")
    links = manifests.extract_links(pages, "http://h")
    assert sorted((r.page_id, r.link) for r in links.collect()) == [(1, "http://h/data/archive/s/1.jpg"), (1, "http://h/data/archive/s/2.jpeg")]
    want = spark.createDataFrame([("1.jpg",), ("2.jpg",)], "file STRING")
    have = spark.createDataFrame([("1.jpg",), ("1.jpg",)], "file STRING")
    assert [r.file for r in manifests.fetch_audit(want, have).collect()] == ["2.jpg"]
    assert manifests.fetch_summary(want, have).first() == (2, 1, 1)


def test_links_of_a_page_by_the_states_of_its_markup(spark):
    html = [
        ("quoted", '<a href="/1">x</a><A id=q HREF = \'/2\' >y</A><a\nhref=/3>z</a><a href=/4/>', ["/1", "/2", "/3", "/4/"]),
        ("comment", '<!-- <a href="/no">x</a> --><a href="/yes">y</a><!-- open <a href="/no">', ["/yes"]),
        ("script", '<script>var s = \'<a href="/no">\';</script><style>a[href="/no"] {}</style><a href="/yes">', ["/yes"]),
        ("attribute", '<div title=\'<a href="/no">\' data-x="a > b"><a title="a > b" href="/yes">t</a></div>', ["/yes"]),
        ("other", '<abbr href="/no"><area href="/no"><a name="n"><a data-href="/no"><a href><b href="/no">', [""]),
        ("twice", '<a href="/first" href="/second">', ["/first"]),
        ("decoded", '<a href=" /a?x=1&amp;y=&quot;2&quot;&amp;lt; ">', ['/a?x=1&y="2"&lt;']),
        ("empty", "", []), ("text", "a < b and <a", []), ("long", "<p>" * 20_000 + "<a " + 'x="1" ' * 3_000 + 'href="/yes">', ["/yes"]),
    ]
    df = spark.createDataFrame([(n, h) for n, h, _ in html] + [("null", None)], "name STRING, html STRING")
    got = {r.name: r.links for r in df.select("name", manifests.link_targets("html").alias("links")).collect()}
    assert got == {n: links for n, _, links in html} | {"null": None}


def test_scoring_batches_and_rounds(spark):
    df = spark.range(1203, numPartitions=2).select("id", F.array(F.col("id") / 1203, F.lit(1.0)).alias("x"))

    def load():
        def model(frame):
            assert len(frame) <= 500
            x = np.stack(frame["x"].to_numpy())
            return [np.stack([x[:, 0], 1 - x[:, 0]], axis=1)] * 3

        return model

    got = scoring.score_images(df, load, ["x"], keys=["id"]).select("id", "crop_type", scoring.argmax_label("crop_type").alias("k")).collect()
    assert len(got) == 1203
    assert all(r.crop_type[0] == pytest.approx(round(r.id / 1203, 4)) and sum(r.crop_type) == pytest.approx(1) for r in got)
    assert all(r.k == (0 if r.crop_type[0] >= r.crop_type[1] else 1) for r in got)


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(catalog.QUERIES) == set(SQL) and set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"phenocam_name", "year", "date", "category", "class", "prior_day_class", "transition", "doy"}
