"""Ids that come several times, with different texts or dependencies."""

from marlstone.llm import simhash, toolcalls


def test_each_group_keeps_a_text_of_its_own(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("apple", "stone", "river"))
    rows = [(3, one, "x"), (5, one, "x"), (5, two, "b"), (5, two, "a"), (6, two, "x"), (5, three, "x"), (None, one, "n")]
    for order in (rows, rows[::-1]):
        for parts in (1, 5):
            df = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(parts)
            left = simhash.one_of_each(df)
            assert left.columns == df.columns
            assert sorted(map(tuple, left.where("doc_id is not null").collect())) == sorted([(3, one, "x"), (5, two, "a"), (5, three, "x")])
            assert left.where("doc_id is null").count() == 1


def test_the_counted_call_has_its_own_dependencies(spark):
    calls = [
        (1, 1, "a", "find", "{}", []), (1, 2, "b", "find", "{}", ["a"]), (1, 5, "a", "find", "{}", ["b"]),
        (2, 1, "a", "find", "{}", ["b"]), (2, 2, "b", "find", "{}", []), (2, 3, "c", "find", "{}", []), (2, 6, "a", "find", "{}", ["c"]),
    ]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    tools = spark.createDataFrame([("find", "{}")], "name string, schema string")
    rows = sorted((r.conv_id, r.position, r.call_id, r.status) for r in toolcalls.linked(calls, results, tools).collect() if r.status != "duplicate_call")
    assert [(c, i, s) for c, _, i, s in rows if c == 1] == [(1, "a", "no_result"), (1, "b", "no_result")]
    assert [i for c, _, i, _ in rows if c == 2] == ["b", "c", "a"]
