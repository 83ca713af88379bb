import random

from logsift.llm import line_dedup


def grams(line):
    """Shingles at every character, as the operator defines them."""
    return {line[i : i + 9] for i in range(max(1, len(line) - 8))}


def norm(line):
    return line.strip(" \t\r\f\x0b").lower()


def brute(rows):
    """Texts that stay, by comparing all lines with all."""
    first = {}
    for doc_id, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        for p, line in enumerate(text.split("\n")):
            if norm(line):
                first.setdefault(norm(line), (doc_id, p))
    lines, parent = list(first), {x: x for x in first}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {x: grams(x) for x in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)), key=lines.index)
                parent[y] = x
    out = []
    for doc_id, text in rows:
        kept = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if not norm(x) or first[find(norm(x))] == (doc_id, p))
        out.append((doc_id, kept))
    return sorted(out, key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_equals_brute_force(make):
    rng = random.Random(7)
    lines = [words(rng, 40) for _ in range(12)]
    edited = [x[:50] + "Z" + x[51:] for x in lines[:6]] + [lines[6].upper(), "  " + lines[7] + "\t", lines[8] + " tail"]
    rows = [(i, "\n".join(rng.sample(lines + edited, 5) + ["", f"own line number {i}"])) for i in range(25)]
    rows += [(30, None), (31, ""), (32, "\n\n"), (None, lines[0] + "\nonly here without an id"), (33, lines[1]), (34, "漢字" * 60 + "\n" + "漢字" * 60), (35, "x" * 20000)]
    got = line_dedup.dedup_lines(make(rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == brute(rows)
    assert all(r["score"] == "x" for r in got)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in got}[30] == (0, 0)


def test_repeated_rows_keep_the_same_lines(make):
    got = line_dedup.dedup_lines(make([(1, "one line\ntwo lines"), (1, "one line\ntwo lines"), (2, "one line")])).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["one line\ntwo lines"] * 2 + [""]


def test_empty_table(make):
    assert line_dedup.dedup_lines(make([])).count() == 0


def test_chain_of_near_lines_is_one_component(make):
    rng = random.Random(3)
    at = words(rng, 60).split(" ")
    rows = []
    for i in range(12):
        rows.append((i, " ".join(at)))
        for _ in range(3):
            at[rng.randrange(60)] = f"new{i}{rng.randint(0, 9)}"
    got = line_dedup.dedup_lines(make(rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(brute(rows))


def test_main_path_is_native(make):
    out = line_dedup.dedup_lines(make([(1, "one line\none line of some more words"), (2, "one line of some more words!")]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 2 and not any(word in plan for word in ("Python", "Pandas", "Arrow", "MapPartitions"))


def test_recall_against_all_pairs(make):
    """Lines of every similarity: the bands lose less than a tenth of the links that all pairs of full sets have."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        base = words(rng, 30)
        rows.append((3 * i, base))
        for k in (1, 2):
            w = base.split(" ")
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(30)] = words(rng, 1)
            rows.append((3 * i + k, " ".join(w)))
    want = {r[0] for r in brute(rows) if not r[1]}
    got = {r["doc_id"] for r in line_dedup.dedup_lines(make(rows)).collect() if not r["text"]}
    assert len(want) > 30 and len(got & want) >= 0.9 * len(want) and got <= want
