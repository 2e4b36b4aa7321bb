from motorfisc.operators import articles


def walked(title, to):
    seen, hops = {title}, 0
    while to.get(title) is not None and to[title] not in seen:
        title = to[title]
        seen.add(title)
        hops += 1
    return title, hops


def test_chains_of_any_length_and_loops_are_followed_to_the_end(spark):
    to = {f"c{i}": f"c{i + 1}" for i in range(21)} | {"self": "self", "a": "b", "b": "a", "t1": "t2", "t2": "x0", "void": None}
    to |= {f"x{i}": f"x{(i + 1) % 5}" for i in range(5)}
    asked = [*to, "c21", "unknown"]
    got = articles.resolved(spark.createDataFrame([(t,) for t in asked], "title string"), spark.createDataFrame(list(to.items()), "from_title string, to_title string")).collect()
    assert {r.title: (r.final, r.hops) for r in got} == {t: walked(t, to) for t in asked} and len(got) == len(asked)
    assert {r.title: r.hops for r in got}["c0"] == 21
