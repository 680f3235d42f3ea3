from pyspark.sql import functions as F

from foliospark.functions import boxes as B
from foliospark.functions import metadata as M
from foliospark.functions import text as T
from foliospark.plans.adapters import ALIASES, KNOWN


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_file_names(spark):
    rows = [
        ("2454聯發科_1150205_台新.pdf", "2026/02/05", "2454", "台新"),
        ("20250318_KGI_資安產業.pdf", "2025/03/18", None, "凱基"),
        ("統一-3217-優群-20250815.pdf", "2025/08/15", "3217", "統一"),
        ("合庫投顧-3363-上詮-20250526.pdf", "2025/05/26", "3363", "合庫"),
        ("2313 華通 | 20260123 | 直邦.pdf", "2026/01/23", "2313", "直邦"),
        ("2024_6728_20250521F04_20260219_193139.pdf", "2025/05/21", "6728", "年報"),
        ("台新投顧20250403 對等關稅.pdf", "2025/04/03", None, None),
    ]
    found = M.parse_metadata(F.col("name"), KNOWN, ALIASES)
    got = spark.createDataFrame([(r[0],) for r in rows], "name string").select("name", *[c.alias(k) for k, c in found.items()]).collect()
    assert [tuple(r) for r in got] == rows


def test_date_shapes(spark):
    for name, date in (("202511128", "2025/11/12"), ("CTBC250901", "2025/09/01"), ("08212025", "2025/08/21"), ("a 2025-3-9", "2025/03/09"), ("b 114年3月9日", "2025/03/09"), ("c 114.12.1", "2025/12/01"), ("none", None)):
        assert one(spark, name, M.parse_date) == date


def test_complete_date_and_broker(spark):
    assert [one(spark, v, M.is_complete_date) for v in ("2025/1/2", "20250102", "2025", "", None)] == [True, True, False, False, False]
    assert [one(spark, v, M.should_ignore_broker) for v in ("Unknow", "unknown ", " ", None, "JPM")] == [True, True, True, True, False]
    assert one(spark, " KGI ", lambda c: M.normalize_broker(c, ALIASES)) == "凱基"


def test_fences(spark):
    assert one(spark, 'x ```json\n{"a": 1}\n``` y', T.strip_code_fence) == '{"a": 1}'
    assert one(spark, " plain ", T.strip_code_fence) == "plain"
    assert one(spark, "```markdown\n# a\n```", T.strip_markdown_fence) == "# a"
    assert one(spark, "a ```b``` c", T.strip_markdown_fence) == "a ```b``` c"


def test_symbols(spark):
    assert one(spark, "ln \n", T.sanitize_wingdings) == "●■■\n"
    assert one(spark, "a", T.sanitize_pua) == "■a●"
    assert one(spark, "F+WingDings2", T.is_symbol_font)


def test_garbled(spark):
    assert [one(spark, v, T.is_garbled) for v in ("abc", "āāāāā", "營運成長", "֐֑֒֓֔", "")] == [False, True, False, True, False]


def test_markdown(spark):
    text = "intro\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\nend"
    segments = T.markdown_segments(text)
    assert [s["type"] for s in segments] == ["text", "table", "text"]
    assert segments[1]["rows"] == [["1", "2"], ["3", "4"]]
    assert T.markdown_segments("| a |\n|---|\n| 1 |")[0]["type"] == "text"  # one column is no table
    assert one(spark, text, lambda c: T.to_markdown(T.parse_markdown(c))) == "intro\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n\nend"


def test_boxes(spark):
    b = lambda *v: F.array(*[F.lit(float(x)) if x is not None else F.lit(None).cast("double") for x in v])
    row = spark.range(1).select(
        B.is_malformed(b(0, 0, 10, 200), F.lit(True)).alias("thin"), B.is_malformed(b(0, 0, 35, 160), F.lit(False)).alias("landscape"), B.is_malformed(b(0, 0, "nan", 10), F.lit(True)).alias("nan"),
        B.not_finite(b(0, 0, "nan", 1)).alias("nf"), B.not_finite(b(0, None, 1, 1)).alias("null0"), B.not_finite(b(0, 1)).alias("short"), B.swap_axes(b(1, 2, 3, 4)).alias("swap"),
    ).first()
    assert (row.thin, row.landscape, row.nan, row.nf, row.null0, row.short, row.swap) == (True, False, False, True, False, True, [2.0, 1.0, 4.0, 3.0])
