import random

import pytest

SF = "/root/testdata/sf0.001"


def components(nodes, linked):
    """Smallest node reachable, by brute force over all pairs."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(root)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, extra columns with clashing names."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeghin") for _ in range(r.randint(1, 7)))
    base = [word() for _ in range(400)]
    passage = [word() for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One two  three"), (None, "a null id here"), (6, " ".join(base)), (7, " ".join(base)), (7, " ".join(base))]
    for k in range(8, 40):
        words = [word() for _ in range(r.randint(1, 300))]
        if k % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = passage[: 30 + k]
        if k % 4 == 0:
            words = list(base)
            words[r.randrange(400)] = word()
        rows.append((k, (" \n"[k % 2]).join(words)))
    rows.append((50, " ".join(word() for _ in range(20000))))
    rows.append((51, "éß日本語 \U0001f600 x y " * 30))
    rows.append((52, "x" * 50000))
    return spark.createDataFrame([(d, t, None if d == 3 else f"s{(d or 0) % 3}", d, "k", 1) for d, t in rows], "doc_id long, text string, source string, n_chars long, _key1 string, rank int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
