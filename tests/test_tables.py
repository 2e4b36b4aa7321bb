from motorfisc.operators import articles


def plain_paths(wikitext):
    """Heading path of each table, line by line."""
    stack, out, depth = [], [], 0
    for line in wikitext.split("\n"):
        if line.startswith("=") and depth == 0:
            level = len(line) - len(line.lstrip("="))
            stack = [h for h in stack if h[0] < level] + [(level, line.strip("= "))]
        depth += line.count("{|")
        if "{|" in line and depth == 1:
            out.append([h[1] for h in stack])
        depth -= line.count("|}")
    return out


def test_paths_of_long_and_repeated_articles(spark):
    lines = []
    for i in range(300):
        lines += [f"{'=' * (2 + i * 7 % 4)} H{i} {'=' * (2 + i * 7 % 4)}", "text", "{|", f"| t{i}", "|}"] if i % 3 else [f"{'=' * (2 + i % 3)} N{i} {'=' * (2 + i % 3)}"]
    texts = [("a", "\n".join(lines)), ("b", "{|\n| lead\n|}\n== X ==\n{|\n| y\n|}"), ("b", "{|\n| lead\n|}\n== X ==\n{|\n| y\n|}"), ("c", ""), ("d", None), ("e", "== only ==")]
    got = articles.tables(spark.createDataFrame(texts, "title string, wikitext string")).collect()
    of = lambda t: [r.heading_path for r in sorted((r for r in got if r.title == t), key=lambda r: (r.segment, r.at))]
    assert of("a") == plain_paths(texts[0][1]) and len(of("a")) == 200
    assert sorted(of("b")) == [[], [], ["X"], ["X"]] and not of("c") and not of("d") and not of("e")
