import pytest

from tallywright.sources.headers import BLOCK, by_range, by_scan, headers
from tallywright.sources.landing import LandingError, list_files, read_files

HEADER = "contribution_id,customer_id,amount,fee_total,transaction_count"
FIRST = {
    "plain": HEADER + "\n" + "1,u,1,1,1\n" * 5_000,
    "other line ends": HEADER + "\r\n1,u,1,1,1\r\n",
    "old line ends": HEADER + "\r1,u,1,1,1\r",
    "header only": HEADER,
    "blank first line": "\n" + HEADER,
    "wide+100%": HEADER + ",x" * 20_000 + "\n1,u,1,1,1\n",
    "é, [a] {b}": "Ä,€,𝒳\n",
}


@pytest.fixture
def listed(spark, tmp_path):
    folder = tmp_path / "new_contributions" / "year=2025" / "month=01" / "day=15"
    folder.mkdir(parents=True)
    for name, text in FIRST.items():
        (folder / f"{name}_20250115_190002.csv").write_bytes(text.encode())
    return list_files(spark, str(tmp_path)).collect()


def name(row):
    return row["key"].split("/")[-1].removesuffix("_20250115_190002.csv")


def test_first_lines_equal_those_of_the_scan(spark, listed):
    assert len(listed) == len(FIRST)
    scanned = dict(by_scan(spark, listed).collect())
    assert headers(spark, listed) == scanned == {f["file_path"]: FIRST[name(f)].replace("\r", "\n").split("\n")[0] for f in listed}


def test_a_header_costs_one_block(spark, listed):
    read = {r["file_path"]: r["bytes_read"] for r in by_range(spark, listed).collect()}
    for file in listed:
        size = len(FIRST[name(file)].encode())
        line = len(FIRST[name(file)].replace("\r", "\n").split("\n")[0].encode())
        assert read[file["file_path"]] <= min(size, (line // BLOCK + 1) * BLOCK)
        assert size < 40_000 or read[file["file_path"]] < size or name(file).startswith("wide")


@pytest.mark.parametrize("block", [1, 7, 61, 62, 63])
def test_blocks_that_end_anywhere(spark, listed, block):
    short = [f for f in listed if not name(f).startswith("wide")]
    assert headers(spark, short, block) == dict(by_scan(spark, short).collect())


def test_file_systems_that_only_spark_knows(spark, tmp_path, listed):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.landing.link./in", tmp_path.as_uri())
    mounted = list_files(spark, "viewfs://landing/in").collect()
    assert [r["header"] for r in by_range(spark, mounted).collect()] == [None] * len(FIRST)
    assert sorted(headers(spark, mounted).values()) == sorted(headers(spark, listed).values())


def test_no_files(spark):
    assert headers(spark, []) == {}


def test_a_missing_column_names_file_and_column(spark, listed):
    with pytest.raises(LandingError, match=r"blank first line_20250115_190002\.csv: missing columns: \['amount'"):
        read_files(spark, [f for f in listed if name(f) == "blank first line"])
