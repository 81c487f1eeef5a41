"""Small tables with the awkward cases, and plain readings of the operators' contracts."""

import random
import re

#: Extra columns whose names the operators use inside.
EXTRA = "score double, class long, id long, row string, kept string, _id long, n_words long, component_id long, ranges string, part int"
SPACES = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.8)) % vocabulary}" for _ in range(n))


def awkward(seed=0):
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows and ids, one very long text, copies and shared passages."""
    rng = random.Random(seed)
    base, passage = prose(rng, 300), prose(rng, 60)
    near = base.split()
    near[100] = "changed"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, base), (5, base.upper()), (6, base), (7, " ".join(near)), (8, "a b c"), (9, "A  b\tc"), (9, "other text here"), (None, base), (None, None)]
    rows += [(20 + k, f"{prose(rng, 40)} {passage} {prose(rng, 30)}") for k in range(6)]
    rows += [(40, prose(rng, 60_000, 5_000)), (41, "same " * 500), (42, "x" * 300_000), (4, base), (43, "é À ß ö " * 9), (44, passage)]
    return rows


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for part in EXTRA.split(", "):
            name, kind = part.split()
            df = df.selectExpr("*", f"cast(1 AS {kind}) AS `{name}`")
    return df


def folded(text):
    return [w for w in SPACES.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]


def shingles(text):
    w = folded(text)
    return {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def join_brute(rows):
    """doc_id, set size, component by comparing every two texts."""
    sets = [shingles(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    at = groups(len(rows), linked)
    least = {}
    for k, (doc, _) in zip(at, rows):
        least[k] = min(least.get(k, 1 << 63), doc if doc is not None else 1 << 63)
    return [(doc, len(s), (least[k] if least[k] < 1 << 63 else None) if s else doc) for k, (doc, _), s in zip(at, rows, sets)]


def repeats_brute(rows):
    """doc_id, words, removed, kept text; rows with one id share positions, null ids come last."""
    texts = [(doc if doc is not None else (1 << 63) - 1, SPACES.findall((t or "").encode())) for doc, t in rows]
    first = {}
    for doc, w in texts:
        for k in range(len(w) - 19):
            key = tuple(w[k: k + 20])
            first[key] = min(first.get(key, (1 << 64, 0)), (doc, k))
    out = []
    for (given, _), (doc, w) in zip(rows, texts):
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k: k + 20])] < (doc, k):
                gone[k: k + 20] = [True] * 20
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((given, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def joined_rows(plan):
    """Rows that the joins of an executed plan made."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    children = plan.children()
    found = sum(joined_rows(p) for p in [*inner, *(children.apply(k) for k in range(children.size()))])
    if name.endswith("JoinExec"):
        found += plan.metrics().apply("numOutputRows").value()
    return found
