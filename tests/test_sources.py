from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewinds.operators import joins
from tradewinds.sources import csv, csv_records, sinks
from tradewinds.sources.schemas import RAW_SCHEMAS


def test_crlf_file_keeps_the_carriage_return(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_bytes(b'customer_id,u,zip,city,state\r\n"c1","u1","01234"," Rio ",RJ\r\n"c2","","","",\r\n')
    rows = csv.load_raw_table(spark, "customers", str(path)).orderBy("customer_id").collect()
    assert [tuple(r) for r in rows] == [("c1", "u1", "01234", " Rio ", "RJ\r"), ("c2", "", "", "", "\r")]


def test_blank_numbers_become_null_and_text_stays_blank(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("a,b,c,d,e,f,g\no1,1,p,s,,10.5,\no2,2,p,s,2017-01-01 00:00:00, ,x\n")
    rows = csv.load_raw_table(spark, "order_items", str(path)).orderBy("order_id").collect()
    assert rows[0]["shipping_limit_date"] == "" and rows[0]["price"] == Decimal("10.50")
    assert [r["freight_value"] for r in rows] == [None, None] and rows[1]["price"] is None


def test_multiline_reviews(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        "review_id,order_id,review_score,t,m,c,a\n"
        'r1,o1,5,"said ""good""","line one\nline two, with comma",2017-01-01 00:00:00,\n'
        "r2,o2,,,,2017-01-01 00:00:00,2017-01-02 00:00:00\n"
    )
    rows = csv.load_raw_table(spark, "order_reviews", str(path)).orderBy("review_id").collect()
    assert len(rows) == 2
    assert rows[0]["review_comment_title"] == 'said "good"'
    assert rows[0]["review_comment_message"] == "line one\nline two, with comma"
    assert rows[1]["review_score"] is None and rows[1]["review_comment_title"] == ""


def test_corrupt_rows_are_counted(spark, tmp_path):
    path = tmp_path / "sellers.csv"
    path.write_text("a,b,c,d\ns1,00001,city,SP\ns2,00002\ns3,00003,city,SP,more\n")
    assert tuple(csv.corrupt_rows(spark, "sellers", str(path)).first()) == ("sellers", 3, 2)
    path = tmp_path / "reviews.csv"
    path.write_text('review_id,o,s,t,m,c,a\nr1,o1,5,t,"two\nlines",x,y\nr2,o2\n')
    assert tuple(csv.corrupt_rows(spark, "order_reviews", str(path)).first()) == ("order_reviews", 2, 1)


def awkward_reviews(seed, rows, line_end="\n"):
    """A file with quoted line breaks, commas and quotes, stray quotes, short and long rows, and empty lines."""
    draw = random.Random(seed)

    def field():
        k = draw.random()
        if k < 0.3:
            return draw.choice(["a", "", "5", "x y", " lead"])
        if k < 0.34:
            return draw.choice(['st"ray', 'it"s "odd"'])
        inner = "".join(draw.choice(["a", "b", " ", ",", '"', "\n", "\n\n", '""', "é"]) for _ in range(draw.randint(0, 12)))
        return '"' + inner.replace('"', '""') + '"'

    lines = ["review_id,o,s,t,m,c,a"]
    for i in range(rows):
        lines.append(",".join([f"r{seed}_{i}", *(field() for _ in range(draw.choice([6] * 8 + [2, 8])))]))
        lines += [""] * (draw.random() < 0.05)
    return line_end.join(lines)


def one_task_reader(spark, path):
    """Spark's own multi-line reader, a file as one task."""
    schema = RAW_SCHEMAS["order_reviews"]
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    read = spark.read.schema(text).options(header=True, multiLine=True, sep=",", quote='"', escape='"', encoding="UTF-8")
    return csv._finish(read.csv(path), schema)


@pytest.fixture
def small_splits(spark):
    kept = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1"}
    for key, value in kept.items():
        spark.conf.set(key, value)
    yield
    for key in kept:
        spark.conf.unset(key)


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
@pytest.mark.parametrize("rows", [1, 1500])
def test_split_files_have_the_rows_of_the_one_task_reader(spark, tmp_path, small_splits, line_end, rows):
    for i in (1, 2):
        (tmp_path / f"{i}.csv").write_bytes((awkward_reviews(i, rows, line_end) + line_end * (i - 1)).encode())
    assert rows < 1000 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = csv.load_raw_table(spark, "order_reviews", str(tmp_path)).collect()
    assert len(got) == 2 * rows and Counter(map(tuple, got)) == Counter(map(tuple, one_task_reader(spark, str(tmp_path)).collect()))


def test_one_record_over_many_splits(spark, tmp_path, small_splits):
    path = tmp_path / "reviews.csv"
    long = 'line, with "quotes"\n' * 2000
    path.write_text('review_id,o,s,t,m,c,a\nr1,o1,5,t,m,x,y\nr2,o2,4,t,"' + long.replace('"', '""') + '",x,y\nr3,o3,3,t,m,x,y\n')
    rows = {r.review_id: r for r in csv.load_raw_table(spark, "order_reviews", str(path)).collect()}
    assert sorted(rows) == ["r1", "r2", "r3"] and rows["r2"].review_comment_message == long and rows["r3"].review_score == 3


def test_a_quote_left_open_takes_the_rest_of_its_file_only(spark, tmp_path, small_splits):
    (tmp_path / "1.csv").write_text('review_id,o,s,t,m,c,a\nr1,o1,5,t,"open' + "\nr,o,1,t,m,c,a" * 400)
    (tmp_path / "2.csv").write_text("review_id,o,s,t,m,c,a\nr2,o2,5,t,m,x,y\n")
    assert {r.review_id for r in csv.load_raw_table(spark, "order_reviews", str(tmp_path)).collect()} == {"r1", "r2"}
    checked = csv.load_checked(spark, "order_reviews", str(tmp_path))
    assert [r.review_id for r in checked.rows.collect()] == ["r2"]
    assert [(r.reason, r.position, r.split_start) for r in checked.rejects.collect()] == [("quote left open", 2, 0)]


def test_rejects_have_place_and_reason(spark, tmp_path):
    path = tmp_path / "sellers.csv"
    path.write_text('a,b,c,d\ns1,00001,city,SP\ns2,00002\ns3,"00,003",city,SP,more\ns4,"00004,city,SP\ns5,,"ci,""ty",\n')
    loaded = csv.load_checked(spark, "sellers", str(path))
    assert sorted(r.seller_id for r in loaded.rows.collect()) == ["s1", "s5"] and loaded.rows.columns == RAW_SCHEMAS["sellers"].names
    found = sorted(loaded.rejects.collect(), key=lambda r: r.position)
    assert [(r.position, r.n_fields, r.reason, r.record) for r in found] == [
        (2, 2, "too few fields", "s2,00002"), (3, 5, "too many fields", 's3,"00,003",city,SP,more'), (4, 4, "quote left open", 's4,"00004,city,SP')
    ]
    assert {(r.table_name, r.file.rsplit("/", 1)[1], r.split_start) for r in found} == {("sellers", "sellers.csv", 0)}


def test_rejects_over_splits_are_the_rows_the_reader_calls_corrupt(spark, tmp_path, small_splits):
    (tmp_path / "r.csv").write_text(awkward_reviews(3, 1200))
    loaded = csv.load_checked(spark, "order_reviews", str(tmp_path))
    counted = csv.corrupt_rows(spark, "order_reviews", str(tmp_path)).first()
    rejects = loaded.rejects.collect()
    assert len(rejects) == counted.corrupt_cnt > 100 and loaded.rows.count() + len(rejects) == counted.row_cnt
    assert {r.reason for r in rejects} == {"too few fields", "too many fields"} and len({r.split_start for r in rejects}) > 10
    lines = {}
    data = (tmp_path / "r.csv").read_bytes()
    for r in rejects:
        # the first lines of a split are those that begin after its first line end
        start = r.split_start and data.index(b"\n", r.split_start) + 1
        lines[r.record] = data[start:].split(b"\n")[r.position - 1].decode()
    assert all(record.split("\n")[0] == line for record, line in lines.items())


def test_csv_round_trip_of_awkward_text(spark, tmp_path):
    schema = RAW_SCHEMAS["category_translation"]
    values = [(' lead and trail ', 'a,b'), ('he said "x"', ""), ("c\r", "tab\t"), ("", "é")]
    df = spark.createDataFrame(values, schema)
    csv.write_csv_table(df, str(tmp_path / "t"))
    back = csv.load_csv_raw(spark, str(tmp_path / "t"), schema)
    assert sorted(tuple(r) for r in back.collect()) == sorted(values)


def test_several_files(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"s{i}.csv").write_text(f"a,b,c,d\ns{i},0000{i},city,SP\n")
    tables = csv.load_raw_tables(spark, {"sellers": [str(tmp_path / "s1.csv"), str(tmp_path / "s2.csv")]})
    assert tables["sellers"].count() == 2


def test_overwrite_table_is_repeatable_and_conforms(spark, tmp_path):
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("k", T.StringType())])
    df = spark.range(100).select(F.lit("x").alias("k"), F.col("id").cast("int").alias("v"), F.lit(1).alias("extra"))
    for _ in range(2):
        written = sinks.overwrite_table(df, str(tmp_path / "t"), schema)
    assert written.count() == 100 and written.dtypes == [("v", "bigint"), ("k", "string")]
    split = sinks.overwrite_table(df, str(tmp_path / "p"), partition_by=["k"])
    assert split.count() == 100 and len(list((tmp_path / "p").glob("_version=*/k=x"))) == 1


def test_small_reports(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    assert [tuple(r) for r in sinks.row_count_report({"x": df, "y": df.limit(0)}).collect()] == [("x", 2), ("y", 0)]
    assert [tuple(r) for r in sinks.schema_report(df).collect()] == [(1, "i", "int", True, 2), (2, "t", "string", True, 1)]
    assert [r["i"] for r in sinks.sample_rows(df, 1, [F.col("i").desc()]).collect()] == [2]
    assert sinks.sample_rows(df, 1).count() == 1
    assert sinks.register_view(df, "some_view").count() == 2


class FakeSession:
    """Just the settings ``shared_folder`` looks at."""

    def __init__(self, setting, master):
        self.conf = self.sparkContext = self
        self.master, self._setting, self._folder = master, setting, None

    def get(self, key, default):
        return self._setting if key == sinks.CHECKPOINT_CONF else default

    def getCheckpointDir(self):
        return self._folder

    def setCheckpointDir(self, folder):
        self._folder = folder


def test_shared_folder_follows_the_cluster_setting():
    assert sinks.shared_folder(FakeSession("s3://bucket/x/", "yarn")) == "s3://bucket/x"
    with pytest.raises(RuntimeError):
        sinks.shared_folder(FakeSession(None, "yarn"))
    local = FakeSession(None, "local[2]")
    assert sinks.shared_folder(local) == sinks.shared_folder(local) != ""


@pytest.mark.parametrize("name", sorted(RAW_SCHEMAS))
def test_every_raw_table_loads_an_empty_file(spark, tmp_path, name):
    path = tmp_path / "t.csv"
    path.write_text(",".join(RAW_SCHEMAS[name].names) + "\n")
    loaded = csv.load_raw_table(spark, name, str(path))
    assert loaded.count() == 0 and loaded.columns == RAW_SCHEMAS[name].names


def test_lines_of_a_split_are_dealt_to_partitions_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "DEALT_FROM", 0)
    monkeypatch.setattr(csv_records, "SEGMENT_BITS", 4)
    monkeypatch.setattr(csv_records, "TEXT_BYTES", 1 << 12)
    for i in (1, 2):
        (tmp_path / f"{i}.csv").write_text(awkward_reviews(i, 1500) + "\n")
    path = str(tmp_path)
    assert spark.read.text(path).rdd.getNumPartitions() <= 2
    records = csv_records.quoted_records(spark, path)
    most = records.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 300
    got = csv.load_raw_table(spark, "order_reviews", path).collect()
    assert len(got) == 3000 and Counter(map(tuple, got)) == Counter(map(tuple, one_task_reader(spark, path).collect()))


def test_places_do_not_depend_on_segments(spark, tmp_path, monkeypatch, small_splits):
    (tmp_path / "1.csv").write_text(awkward_reviews(5, 800) + "\n")
    place = ["split_start", "position", "reason", "record"]
    before = rows_of(csv.load_checked(spark, "order_reviews", str(tmp_path)).rejects.select(place))
    monkeypatch.setattr(csv_records, "SEGMENT_BITS", 1)
    assert before and rows_of(csv.load_checked(spark, "order_reviews", str(tmp_path)).rejects.select(place)) == before


def rows_of(df):
    return Counter(map(tuple, df.collect()))
