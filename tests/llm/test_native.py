import pytest
from pyspark.sql import functions as F

from ontomill.llm import chat, line_dedup, native_queries as Q, url_filter as U
from tests.llm.awkward import ROWS, awkward, empty
from tests.llm.oracle import rows_of, sql_rows

SF = "/root/testdata/sf0.01"
TABLE = {"op4_line_dedup": "documents", "op7_url_filter": "pages", "op8_chat": "conversations"}


@pytest.mark.parametrize("name", list(TABLE))
def test_against_sql(spark, name):
    t = TABLE[name]
    assert rows_of(Q.QUERIES[name](spark, SF)) == sql_rows(Q.SQL[name], {t: f"{SF}/{t}.parquet"})


@pytest.mark.parametrize("name", list(TABLE))
def test_plan_has_no_python(spark, name, capsys):
    Q.QUERIES[name](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def saved(df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_lines_awkward(spark, tmp_path):
    rows = [(i, f"head line\nbody {i}\n\n  \nfoot\nfoot", "en", s, 1) for i, s in enumerate(["a"] * 6 + [None] * 7 + [""] * 2)]
    df = spark.createDataFrame(rows + ROWS + ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    at = saved(df, tmp_path, "documents")
    got = rows_of(Q.op4_line_dedup(spark, at))
    assert got == sql_rows(Q.SQL_OP4, {"documents": df})
    out = line_dedup.drop_boilerplate(awkward(spark), F.col("source"))
    assert out.count() == len(ROWS) and "cls" in out.select("__row.*").columns
    assert line_dedup.drop_boilerplate(empty(spark), F.col("source")).count() == 0


URLS = [None, "", "x", "http://", "HTTP://Example.NET/en/1", "http://a.b.example.net/EN/", "http://net/", "http://xnet/", "http://n.net", "http://n.net?/x", "http://é.ORG/fr/#x", "http://org/fr/", "http://u@example.com:80/de/", "http://example.com/de/", "http://a..example.com/de/x", "a://b://example.com/de/", "http://www.spam-farm.example.org/x", "http://notspam-farm.example.org/x", "http://spam-farm.example.org/fr/", "http://casino-win.example.net/en/", "http://h" + "a" * 5000 + ".net/" + "b" * 5000]


def test_urls_awkward(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)] + [(None, "http://example.org/fr/", None)] * 2, "page_id long, url string, html string")
    at = saved(df, tmp_path, "pages")
    assert rows_of(Q.op7_url_filter(spark, at)) == sql_rows(Q.SQL_OP7, {"pages": df})
    clash = df.selectExpr("*", "'x' as rule", "'y' as key", "'z' as host")
    out = U.judge(clash, Q.RULES, Q.BLOCKED_HOSTS)
    assert out.count() == len(URLS) + 2 and out.columns.count("rule") == 1
    assert U.judge(df.limit(0), Q.RULES, []).count() == 0
    assert U.judge(df, [], []).where("verdict <> 'allow' or rule is not null").count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("pmod(xxhash64(key), 7) = 0")
    c = U.build(listed, universe.unionAll(universe))
    assert len(c.levels) > 2
    wrong = universe.withColumn("in", c.holds(F.col("key"))).where("in <> (pmod(xxhash64(key), 7) = 0)")
    assert wrong.count() == 0
    assert universe.where(U.build(listed.limit(0), universe).holds(F.col("key"))).count() == 0
    with pytest.raises(ValueError):
        U.bloom(universe, 1 << 40, 0.5, 0)


TURNS = [
    (1, 0, "system", "be kind \\ <|im_start|> \\s"), (1, 1, "user", "hi " * 900), (1, 2, "assistant", "well " * 500), (1, 3, "user", "a"), (1, 4, "assistant", "b <|im_end|>\n"), (1, 5, "assistant", "long " * 3000), (1, 6, "user", None), (1, 7, None, "no role"),
    (2, 0, "user", ""), (3, None, "assistant", "no turn"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 0, "user", "u"), (None, 1, "assistant", "é😀<"), (4, 0, "a\nb", "\\n<|\n|>"), (5, 0, "system", "only"),
    *[(6, i, ("user", "assistant")[i % 2], f"turn {i} " * 30) for i in range(60)],
]


def test_chat_awkward(spark, tmp_path):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3)
    at = saved(df.selectExpr("*", "'x' as window", "'y' as kind", "'z' as body"), tmp_path, "conversations")
    assert rows_of(Q.op8_chat(spark, at)) == sql_rows(Q.SQL_OP8, {"conversations": df})
    w = chat.windows(df, 256, 64).collect()
    six = sorted((r for r in w if r.conv == 6), key=lambda r: r.window)
    assert len(six) > 5 and all(r.n_context > 0 for r in six[1:]) and six[0].n_context == 0
    one = [r for r in w if r.conv == 1]
    assert all(r.formatted.startswith("<|im_start|>system\n") for r in one)
    assert sum(len(r.loss) for r in w) == sum(t[2] == "assistant" for t in TURNS)
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


def test_windows_keep_the_budget(spark):
    """System turn, history and own turns together; only a single turn longer than what is left may exceed it."""
    conversations = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").unionByName(conversations)
    cost = lambda marked: (len(marked.split("\n", 1)[1]) + 3) // 4 + 4
    for budget, history in ((1024, 128), (128, 32), (20, 8)):
        over = split = 0
        for r in chat.windows(df, budget, history).collect():
            turns = r.formatted.split("<|im_end|>\n")[:-1]
            costs = [cost(t) for t in turns]
            system = costs[0] if turns[0].startswith("<|im_start|>system\n") else 0
            if sum(costs) > budget:
                over += 1
                assert len(turns) - r.n_context == 1 and costs[-1] > budget - history - system and r.n_context <= 1
            split += r.n_context > 0
        assert split > 5 and (budget > 20 or over > 0)


def test_long_lists_are_split(spark, tmp_path):
    """A list too long for one cascade is split by hash of the key; nothing else changes."""
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)] + [(None, "http://example.org/fr/", None)] * 2, "page_id long, url string, html string").unionByName(spark.read.parquet(f"{SF}/pages.parquet"))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    want = rows_of(U.judge(df, Q.RULES, Q.BLOCKED_HOSTS).select(*columns))
    assert rows_of(U.judge(df, Q.RULES, Q.BLOCKED_HOSTS, max_bits=256).select(*columns)) == want
    many = spark.range(3000).select(F.concat(F.lit("listed"), "id", F.lit(".example.org")).alias("key")).unionAll(U.keys(spark, Q.BLOCKED_HOSTS))
    assert rows_of(U.judge(df, Q.RULES, many).select(*columns)) == want
    assert U.judge(df.limit(0), Q.RULES, many, max_bits=64 * 64).count() == 0
