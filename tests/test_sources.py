import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import features
from tickloom.schema import PRICE_COLUMNS
from tickloom.sources import readers, writers


def _write(path, *lines):
    path.write_text("\n".join(lines) + "\n")


def _price_line(day, t, product, mid):
    return f"{day};{t};{product};10;1;;;8;3;12;2;;;;;{mid};0.0"


@pytest.fixture
def price_folder(tmp_path):
    header = ";".join(PRICE_COLUMNS)
    _write(tmp_path / "a.csv", header, _price_line(0, 100, "OPT_1", 11), _price_line(0, 0, "OTHER", "11.5"))
    _write(tmp_path / "b.csv", _price_line(1, 0, "OTHER", "oops"), header, ";1;nameless;;;;;;;;;;;;;;")
    return tmp_path


def test_price_files(spark, price_folder):
    out = readers.scan_price_folder(spark, str(price_folder))
    assert out.columns == PRICE_COLUMNS
    assert {(r.day, r.product, r.mid_price) for r in out.collect()} == {("0", "OPT_1", "11"), ("0", "OTHER", "11.5"), ("1", "OTHER", "oops")}
    table = features.price_file_features(out, key="base_product", fold_prefixes=["OPT_"])
    rows = {(r.base_product, r.round_timestamp): r for r in table.collect()}
    assert set(rows) == {("OPT", 100), ("OTHER", 0), ("OTHER", 1000000)}
    assert rows["OTHER", 1000000].mid_price == 0.0 and rows["OTHER", 1000000].log_return is None
    assert rows["OPT", 100].total_bid_volume == 4.0
    assert len(table.columns) == 17 + 31


def test_price_file_with_header(spark, price_folder):
    out = readers.scan_prices_header(spark, str(price_folder / "a.csv")).orderBy("timestamp")
    rows = out.collect()
    assert [(r.timestamp, r.mid_price, r.bid_price_2) for r in rows] == [(0, 11.5, None), (100, 11.0, None)]


def test_empty_folder(spark, tmp_path):
    assert readers.scan_price_folder(spark, str(tmp_path)).count() == 0
    assert readers.scan_quotes(spark, str(tmp_path)).count() == 0
    assert readers.scan_features(spark, str(tmp_path), T.StructType([T.StructField("x", T.DoubleType())])).count() == 0


def test_quotes_with_either_name(spark, tmp_path):
    _write(tmp_path / "a.csv", "timestamp,product,side,price,quantity,order_id,type", "2024-01-01 00:00:00,X,BID,10,0.5,o1,limit", "2024-01-01 00:01:00,X,ASK,bad,0.25,o2,limit")
    _write(tmp_path / "b with space.csv", "side,timestamp,symbol,price,quantity", "ASK,2024-01-01 00:00:00,Y,12,1")
    _write(tmp_path / "c.csv", "timestamp,side,price,quantity", "2024-01-01 00:00:00,BID,1,1")
    (tmp_path / "d.csv").write_text("")
    out = readers.scan_quotes(spark, str(tmp_path))
    rows = {(r["product"], r.side, r.price, r.quantity, r.order_id) for r in out.collect()}
    assert rows == {("X", "BID", 10.0, 0.5, "o1"), ("X", "ASK", None, 0.25, "o2"), ("Y", "ASK", 12.0, 1.0, None)}
    assert out.select("source_file").distinct().count() == 2


def test_features_by_file_name(spark, tmp_path):
    _write(tmp_path / "A_B_features.csv", "timestamp,x", "1,2.5")
    _write(tmp_path / "C_features.csv", "timestamp,x", "1,3.5", "2,4.5")
    _write(tmp_path / "other.csv", "timestamp,x", "1,9")
    schema = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("x", T.DoubleType())])
    out = readers.scan_features(spark, str(tmp_path), schema)
    assert {tuple(r) for r in out.collect()} == {(1, 2.5, "A_B"), (1, 3.5, "C"), (2, 4.5, "C")}


@pytest.fixture
def small_files(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, "16k")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_split_write_and_read_back(spark, small_files, tmp_path, format):
    df = spark.range(0, 60000, 1, 8).select(F.when(F.col("id") % 300 == 0, "a b").otherwise("hot").alias("product"), "id")
    path = str(tmp_path / "out")
    files = lambda product: [f for f in os.listdir(f"{path}/product={product}") if f.startswith("part")]
    writers.write_split(df, path, format=format)
    back = spark.read.schema("id long, product string").option("header", True).format(format).load(path)
    assert sorted(map(tuple, back.collect())) == sorted((r.id, r.product) for r in df.collect())
    assert len(files("hot")) > 1
    writers.write_split(df, path, format=format, one_file=True)
    assert len(files("hot")) == 1


def test_tables_and_state(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0], {"x": 3})], "product string, history array<double>, position map<string,long>")
    writers.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    text = df.select(writers.state_to_json("product", "history", "position").alias("state"))
    assert text.first().state == '{"history":[1.0,2.0],"position":{"x":3},"product":"a"}'
    schema = "history array<double>, position map<string,bigint>, product string"
    back = text.select(writers.state_from_json(F.col("state"), schema).alias("s")).select("s.*").first()
    assert back.history == [1.0, 2.0] and back.position == {"x": 3}
    broken = spark.createDataFrame([("{oops",)], "state string").select(writers.state_from_json(F.col("state"), schema).alias("s"))
    assert broken.first().s is None or broken.first().s["product"] is None


def test_names(spark):
    both = spark.createDataFrame([("p", "s"), (None, "s")], "product string, symbol string")
    assert [r["product"] for r in readers.alias_symbol(both).collect()] == ["p", "s"]


def test_quote_headers_by_csv_rules(spark, tmp_path):
    long = ",".join(f"extra{i}" + "x" * 300 for i in range(250))
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbf" + b"timestamp,symbol,side,price,quantity\n1,X,BID,10,2\n")
    _write(tmp_path / "quoted.csv", '"side","product","timestamp","price","quantity","a, b"', 'ASK,"Y, Z",2,11,3,4')
    _write(tmp_path / "long.csv", f"{long},product,side,price,quantity,timestamp", "," * 250 + "W,BID,12,NaN,3")
    _write(tmp_path / "none.csv", "side,price", "BID,1")
    (tmp_path / "empty.csv").write_text("")
    rows = {(r.timestamp, r["product"], r.side, r.price, r.quantity) for r in readers.scan_quotes(spark, str(tmp_path)).collect()}
    assert rows == {("1", "X", "BID", 10.0, 2.0), ("2", "Y, Z", "ASK", 11.0, 3.0), ("3", "W", "BID", 12.0, None)}
    unused = {(os.path.basename(r.source_file), r.reason) for r in readers.unused_quote_files(spark, str(tmp_path)).collect()}
    assert unused == {("none.csv", "no name column")}


def test_feature_files_by_name(spark, tmp_path):
    schema = T.StructType.fromDDL("timestamp bigint, rsi double, x double")
    _write(tmp_path / "A_features.csv", "timestamp,rsi", "1,50.5")
    _write(tmp_path / "B_features.csv", "x,rsi,timestamp", "0.5,60.5,2")
    _write(tmp_path / "C_features.csv", "other", "1")
    rows = {tuple(r) for r in readers.scan_features(spark, str(tmp_path), schema).filter("product <> 'C'").collect()}
    assert rows == {(1, 50.5, None, "A"), (2, 60.5, 0.5, "B")}
    unused = readers.unused_feature_files(spark, str(tmp_path), schema).collect()
    assert [(os.path.basename(r.source_file), r.reason) for r in unused] == [("C_features.csv", "no known column")]


def _bytes_read(spark):
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_headers_need_the_beginning_of_a_file_only(spark, tmp_path):
    line = "2024-01-01 00:00:00,BID,10,0.5," + "x" * 1000
    for i in range(2):
        _write(tmp_path / f"{i} a.csv", ("timestamp,side,price,quantity,symbol", "\ufeff\"symbol\",timestamp\r")[i], *[line] * 20_000)
    (tmp_path / "empty.csv").write_text("")
    size = sum(f.stat().st_size for f in tmp_path.iterdir())
    before = _bytes_read(spark)
    headers = {os.path.basename(r.source_file): r.names for r in readers.file_headers(spark, f"{tmp_path}/*.csv").collect()}
    assert headers == {"0%20a.csv": ["timestamp", "side", "price", "quantity", "symbol"], "1%20a.csv": ["symbol", "timestamp"]}
    assert readers.scan_quotes(spark, str(tmp_path)).agg(F.count("source_file")).first()[0] == 40_000
    # One scan of the files, and the checkpoints of the few headers.
    assert _bytes_read(spark) - before < 1.25 * size


def test_headers_by_scan_where_files_cannot_be_opened(spark, tmp_path, monkeypatch):
    _write(tmp_path / "a.csv", "product,price,side", "X,3,BID")
    expected = [tuple(r) for r in readers.file_headers(spark, f"{tmp_path}/*.csv").collect()]
    monkeypatch.setattr(readers, "_first_line", lambda uri: None)
    assert [tuple(r) for r in readers.file_headers(spark, f"{tmp_path}/*.csv").collect()] == expected == [(expected[0][0], ["product", "price", "side"])]


def test_header_lines_of_any_length(tmp_path):
    path = tmp_path / "a.csv"
    for text, line in (("", ""), ("a,b", "a,b"), ("a" * 100_000 + "\r\nb", "a" * 100_000)):
        path.write_bytes(text.encode())
        assert readers._first_line(path.as_uri()) == line
    assert readers._first_line("unknown://x/a.csv") is None


def test_an_empty_name_keeps_its_place(spark, tmp_path):
    _write(tmp_path / "a.csv", 'product,,"pri""ce", price ,side', "X,1,2,3,BID")
    assert [(r["product"], r.price, r.side) for r in readers.scan_quotes(spark, str(tmp_path)).collect()] == [("X", 3.0, "BID")]


def test_trading_states_have_their_keys_in_order(spark):
    rows = spark.createDataFrame([(1, "b", 2, [3]), (1, "a", 1, None), (1, None, 9, [9]), (2, "c", None, None)], "t long, product string, position long, trades array<long>")
    out = {r.t: r.state for r in writers.trading_states(rows, "t", "product", ["position", "trades"]).collect()}
    assert out == {1: '{"position":{"a":1,"b":2},"t":1,"trades":{"b":[3]}}', 2: '{"position":{},"t":2,"trades":{}}'}
    assert writers.trading_states(rows.limit(0), "t", "product", ["position"]).collect() == []
