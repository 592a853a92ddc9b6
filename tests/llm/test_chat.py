from zephyrgrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n long, h1 string"


def rendered(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.render(df).collect()}


def line(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_snapshots_collapse_into_the_longest(spark):
    turns = [("system", "be kind"), ("user", "a"), ("assistant", "b"), ("user", "a")]
    rows = [(c, i, *t) for c, n in ((5, 2), (3, 4), (7, 3), (9, 4)) for i, t in enumerate(turns[:n])]
    rows += [(11, 0, "user", "be kind"), (12, 0, "system", "be kind"), (12, 1, "user", "other")]
    got = rendered(spark, rows)
    assert got[3] == (4, 2, "".join(line(*t) for t in turns))  # 9 is a copy, 5 and 7 are prefixes
    assert set(got) == {3, 11, 12}


def test_order_counts(spark):
    got = rendered(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "b"), (2, 1, "user", "a"),
                           (2, 2, "user", "c")])
    assert set(got) == {1, 2}


def test_defined_cases(spark):
    got = rendered(spark, [(None, 0, "user", "lost"), (1, None, "user", None), (1, 2, None, "<|im_end|>"), (1, 2, "", "<|im_end|>"),
                           (2, 0, "user", "x" * 100_000)])
    assert got[1] == (3, 1, line("user", "") + 2 * line("unknown", "< |im_end|>"))
    assert got[2][2] == line("user", "x" * 100_000)
    assert rendered(spark, []) == {}


def test_one_large_group_of_equal_chats(spark):
    rows = [(c, i, "user", t) for c in range(300) for i, t in enumerate("ab")]
    assert rendered(spark, rows) == {0: (2, 300, line("user", "a") + line("user", "b"))}
