from itertools import combinations

from quire.operators.blocks import class_pairs, name_classes


def _members(spark, rows):
    return name_classes(spark.createDataFrame(rows, "id long, names array<string>, resource string")).cache()


def test_large_classes_stay(spark):
    c = _members(spark, [(i, ["Steel bolt" if i < 300 else "Steel nut"], None) for i in range(500)] + [(i, [f"x{i}"], "http://a/") for i in range(500, 750)])
    rows = {tuple(r) for r in c.collect()}
    assert {r for r in rows if r[1] == "n:steel bolt"} == {(i, "n:steel bolt") for i in range(300)}
    assert {r for r in rows if r[1] == "r:http://a"} == {(i, "r:http://a") for i in range(500, 750)}
    assert class_pairs(c).count() == 0  # "steel" has 500 members; bolt and nut share no other key


def test_pairs_like_brute_force(spark):
    names = ["Stone gate", "Stone gates", "Stonework", "SG", "Gate of stone", "Oak door", "oaken", "od", "Über door"]
    c = _members(spark, [(i, [n, "od"] if i == 4 else [n], "r" if i in (2, 7) else None) for i, n in enumerate(names)])
    classes: dict[str, set] = {}
    for i, k in (tuple(r) for r in c.collect()):
        classes.setdefault(k, set()).add(i)
    pairs = {tuple(r) for r in class_pairs(c, 4).collect()}
    got = {p for m in classes.values() for p in combinations(sorted(m), 2)} | {(min(i, j), max(i, j)) for a, b in pairs for i in classes[a] for j in classes[b] if i != j}
    # written out from the reference's blocks: stone 0 1 4, ston 0 1 2 4, gate 0 1 4, sg 0 1 3, od 4 5 7, door 5 8, oak is no token of 6, oaken 6, r 2 7
    want = {p for m in ([0, 1, 2, 4], [0, 1, 3], [4, 5, 7], [5, 8], [2, 7]) for p in combinations(m, 2)}
    assert got == want
    assert ("n:od", "n:stone gate") not in pairs and ("n:sg", "n:stone gate") in pairs
    small = {tuple(r) for r in class_pairs(c, 2).collect()}
    assert small == {("n:oak door", "n:uber door")}
