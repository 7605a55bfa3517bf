from ledgerloom.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, own string, level int"


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {(r["conv_id"], r["turn"]): r for r in quotes.link(df).collect()}


def test_nested_quotes_find_their_messages(spark):
    rows = [
        (1, 0, "a", "Where do we meet?\nI like the park."),
        (1, 1, "b", "> Where do  we MEET?\n\nAt the station."),
        (1, 2, "c", "On Monday b wrote:\n>> Where do we meet?\n> At the station.\nToo far for me.\n"),
        (1, 5, "d", "> I like the park.\nSo do I."),
        (1, 6, "e", "> never said by anyone\nHm."),
        (2, 0, "a", "> Where do we meet?\nQuote from elsewhere."),
    ]
    found = linked(spark, rows)
    assert [found[1, t]["reply_to"] for t in (0, 1, 2, 5, 6)] == [None, 0, 1, 0, 5]
    assert found[1, 2]["max_level"] == 2 and found[1, 2]["n_linked"] == 2 and found[1, 2]["own"] == "Too far for me."
    assert found[1, 1]["own"] == "At the station." and found[2, 0]["n_linked"] == 0 and found[2, 0]["reply_to"] is None
    order = [t for _, t in sorted((found[1, t]["reply_order"], t) for t in (0, 1, 2, 5, 6))]
    assert order == [0, 1, 5, 2, 6]
    assert all(order.index(found[1, t]["reply_to"]) < order.index(t) for t in (1, 2, 5, 6))


def test_a_quotation_may_be_wrapped_anew_and_repeat(spark):
    rows = [
        (1, 0, "a", "The first sentence is rather long.\nThe second one is shorter. Yes!"),
        (1, 1, "b", "Something else."),
        (1, 2, "c", "> The first sentence\n> is rather  long. The second\n> one is shorter.\nI agree."),
        (1, 3, "d", ">> The first sentence is rather long.\nOnly an ancestor is quoted."),
        (1, 4, "e", "Something else."),
        (1, 5, "f", "> Something else.\nThe later one."),
        (1, 2000, "g", "> I agree.\n>\n>> Yes!\nSo do I."),
    ]
    found = linked(spark, rows)
    assert [found[1, t]["reply_to"] for t in (2, 3, 5, 2000)] == [0, 0, 4, 2]
    assert found[1, 2]["n_linked"] == 2 and found[1, 2000]["n_linked"] == 2 and found[1, 2000]["max_level"] == 2


def test_many_turns_cross_stretches(spark):
    turns = [0, 1, 1023, 1024, 5000, 5001]
    found = linked(spark, [(1, t, "a", f"text {t}") for t in turns])
    assert [found[1, t]["reply_to"] for t in turns] == [None, *turns[:-1]]


def test_odd_messages(spark):
    rows = [(1, 0, None, None), (1, 1, "a", ""), (1, 2, "a", ">>>\n> \n>"), (1, 3, "a", "same"), (1, 3, "a", "same"), (None, 1, "a", "> same"), (1, None, "a", "> same\nown"), (3, -5, "a", "x"), (3, 2, "b", "> x"), (4, 0, "z", "y " * 50_000 + "\n" + "> q\n" * 2000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = quotes.link(df).collect()
    assert len(out) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in out}
    assert by[1, 2]["n_quoted"] == 0 and by[1, 2]["own"] == "" and by[None, 1]["reply_to"] is None and by[1, None]["own"] == "own"
    assert by[3, 2]["reply_to"] == -5 and by[4, 0]["n_quoted"] == 1
    assert quotes.link(df.where("conv_id > 99")).count() == 0


def test_long_runs_of_marks_blanks_and_empty_lines(spark):
    n = 100_000
    marks, blanks = ">" * n + " deep", "x" + " " * n + "y\n" + " \t" * n
    rows = [(1, 0, "a", marks), (1, 1, "a", "> " * n + "deep"), (1, 2, "a", "\n" * n + "own"), (1, 3, "a", " \r\n" * n), (1, 4, "a", blanks), (1, 5, "a", (" " * n + "\n") * 3 + "on " * n + ":")]
    found = linked(spark, rows)
    assert found[1, 0]["max_level"] == found[1, 1]["max_level"] == n and found[1, 0]["n_quoted"] == 1
    assert found[1, 2]["own"] == "own" and found[1, 3]["own"] == "" and found[1, 4]["own"] == "x" + " " * n + "y"
