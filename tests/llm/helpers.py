"""Small documents with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, row int, label string"


def awkward(spark, texts):
    """Documents of the given texts plus null, empty, blank and repeated rows,
    null ids and columns whose names operators use inside."""
    rows = [(i, t, "en", "s1", len(t), 1, "k", 2, "l") for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(n, None, None, None, None, None, None, None, None), (n + 1, "", "en", "s2", 0, 1, "k", 2, "l"),
             (n + 2, " \n\t ", "en", None, 4, 1, "k", 2, "l"), rows[0], (None, texts[0], "en", "s1", 1, 1, "k", 2, "l")]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
