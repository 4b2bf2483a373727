import collections
import hashlib
import random
import zlib

import duckdb
import helpers
import numpy as np
import pytest
from evalspark.llm import prefix_trie, toxicity, vector_codes
from evalspark.llm.queries import ORACLE, QUERIES

NODE = prefix_trie._NODE
CODE = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
CLASHING = "key string, block int, parent_key string, kind int, own int, turns int, words string"


def naive_trie(convs):
    """Nodes of {conv_id: [(turn, words of the turn)]} by the definition."""
    members = collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, own in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(own) - 1) * k[-1][1] if k else 0
            leaves[k[:d]] += not children[k]
    rows = []
    for k, own in members.items():
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(k))
        parent = members[k[:-1]][0] if k else None
        rows.append((own[0], len(k), parent, len(own), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def token(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32]


def turns_of(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0, token(role, text)), (token(role, text), len(helpers.words(text)))))
    return {c: [t for _, t in sorted(own)] for c, own in convs.items()}


def openings(convs):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: convs.get(c - c % 20, [])[: h[c]] + own[h[c] :] for c, own in convs.items()}


def conversations(spark, seed, n=250):
    """Nulls, ties, repeated rows, copies, prefixes of each other, a long one, a hot first turn; with clashing columns."""
    dice, rows = random.Random(seed), []
    for c in range(n):
        for t in range(dice.choice([0, 1, 2, 2, 3, 9])):
            role = dice.choice(["u", "a", None]) if t > 1 else "u"
            rows.append((c, dice.choice([t, t, None]), role, dice.choice(["x", "x y", None, "z  z\tz", "éé 👍"]) if t else "same"))
    rows += [(n, t, "u", "same" if t == 0 else f"long {t}") for t in range(400)] + [(None, 1, "u", "x")] + rows[:20]
    schema = f"conv_id long, turn long, role string, text string, {CLASHING}"
    return rows, spark.createDataFrame([(*r, "k", 1, "p", 2, 3, 4, "w") for r in rows], schema)


@pytest.mark.parametrize(("turns", "rows", "chunk"), [(200_000, 50_000, 50_000), (15, 4, 2), (1, 1, 1)])
@pytest.mark.parametrize("shared", [True, False])
def test_trie_equals_brute_force(spark, monkeypatch, turns, rows, chunk, shared):
    for name, value in (("BLOCK_TURNS", turns), ("BLOCK_ROWS", rows), ("CHUNK", chunk)):
        monkeypatch.setattr(prefix_trie, name, value)
    given, docs = conversations(spark, turns)
    convs, sequences = turns_of(given), prefix_trie.sequences(docs)
    if shared:
        convs, sequences = openings(convs), prefix_trie.with_shared_openings(sequences)
    found = prefix_trie.trie(sequences)
    assert found.columns == list(NODE)
    assert helpers.plain(found, *NODE) == naive_trie(convs)


def test_trie_edges(spark):
    _, docs = conversations(spark, 1, n=3)
    assert prefix_trie.trie(prefix_trie.sequences(docs.limit(0))).collect() == []
    # Conversations of which nothing is left, and one whose opening is absent.
    ids = [c for c in range(1, 300) if zlib.crc32(str(c).encode()) % 4 == 3][:5]
    given = [(c, 0, None, None) for c in ids]
    frame = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    found = prefix_trie.trie(prefix_trie.with_shared_openings(prefix_trie.sequences(frame)))
    assert helpers.plain(found, *NODE) == naive_trie(openings(turns_of(given))) and found.count() == 1


def test_range_minima():
    dice = np.random.default_rng(4)
    for n in (1, 2, 7, 64, 100):
        values = dice.integers(0, 6, n)
        minima = prefix_trie.Minima(values)
        a, b = np.triu_indices(n)
        assert minima.least(a, b).tolist() == [values[i : j + 1].min() for i, j in zip(a, b, strict=True)]
        at, depth = dice.integers(0, n, 50), dice.integers(0, 7, 50)
        for i, d, left, right in zip(at, depth, minima.leftmost(at, depth), minima.rightmost(at, depth, n), strict=True):
            assert (values[left + 1 : i + 1] >= d).all() and (left == 0 or values[left] < d)
            assert (values[i + 1 : right + 1] >= d).all() and (right == n - 1 or values[right + 1] < d)


def same_as_sql(spark, name, data=helpers.DATA):
    table = "conversations" if "trie" in name else "embeddings"
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
        cursor = duck.execute(ORACLE[name])
        names, rows = [d[0] for d in cursor.description], cursor.fetchall()
    found = QUERIES[name](spark, data)
    assert sorted(found.columns) == sorted(names)
    assert helpers.plain(found, *names) == sorted(rows, key=str) and rows


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_vector_codes"])
def test_queries_equal_sql(spark, name):
    same_as_sql(spark, name)


def naive_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes of [(vec_id, vector, label)] with every distance computed in every round."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    cells = [[int(np.floor(x * scale)) for x in r[1]] for r in rows]
    width = len(cells[0]) // parts
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, cells[k]))
    x = [[c[p * width : (p + 1) * width] for p in range(parts)] for c in cells]
    books = [[list(x[k][p]) for k in order[:entries]] for p in range(parts)]

    def far(a, b):
        return sum((i - j) ** 2 for i, j in zip(a, b, strict=True))

    for step in range(rounds + 1):
        codes = [[min(range(len(book)), key=lambda e: (far(row[p], book[e]), e)) for p, book in enumerate(books)] for row in x]
        for p in range(parts) if step < rounds else ():
            for e in range(len(books[p])):
                own = [row[p] for row, code in zip(x, codes, strict=True) if code[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    errors = [sum(far(row[p], books[p][c[p]]) for p in range(parts)) for row, c in zip(x, codes, strict=True)]
    by = collections.Counter()
    for r, e in zip(rows, errors, strict=True):
        by[r[2]] += e
    shown = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return sorted(((r[0], bytes(c).hex(), e, by[r[2]], shown) for r, c, e in zip(rows, codes, errors, strict=True)), key=str)


@pytest.mark.parametrize("n", [5, 120])
def test_codes_equal_brute_force(spark, n):
    dice = random.Random(n)
    rows = [(k, [dice.choice([-1.5, -0.25, 0.0, 0.1, dice.random()]) for _ in range(16)], dice.choice([1, 2, None])) for k in range(n)]
    rows += [(n, rows[0][1], 1), (0, rows[1][1], 2), (0, rows[1][1], 2), (None, rows[2][1], None)]  # copies, repeated ids, no id
    bad = [(n + 1, None, 1), (n + 2, [None] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [float("inf")] * 16, 1), (n + 5, [0.5] * 8, 1), (n + 6, [], 1)]
    schema = "vec_id long, embedding array<double>, label int, code string, cells int, far int, at int"
    table = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows + bad], schema)
    assert helpers.plain(vector_codes.compress(table), *CODE) == naive_codes(rows)
    assert vector_codes.compress(table.limit(0)).count() == 0


def test_codes_refuse(spark):
    table = spark.createDataFrame([(1, [0.0] * 12, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="divide"):
        vector_codes.compress(table)
    table = spark.createDataFrame([(1, [1e300] * 8, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="no exact error"):
        vector_codes.compress(table).collect()


def test_moved_entries_alone_decide():
    """After any movement of entries the codes and distances are those of a full comparison."""
    dice = np.random.default_rng(9)
    rows = dice.integers(-4, 5, (600, 3))
    entries = dice.integers(-4, 5, (16, 3))
    code, far = vector_codes.nearest(rows, entries)
    for _ in range(40):
        moved = dice.random(16) < dice.choice([0, 0.1, 0.5, 1])
        entries = np.where(moved[:, None], dice.integers(-4, 5, (16, 3)), entries)
        code, far = vector_codes.reassign(rows, entries, moved, code, far)
        whole = vector_codes.nearest(rows, entries)
        assert (code == whole[0]).all() and (far == whole[1]).all()


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    found = QUERIES["op13_toxicity"](spark, data).collect()
    assert len(found) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    judged = [(labels[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in labels]
    assert np.mean([p for y, p in judged if y]) > 0.85 and np.mean([p for y, p in judged if not y]) < 0.01


def test_toxicity_never_sees_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id AS string)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    one, two = (helpers.plain(toxicity.classify(docs, x), "doc_id", "score") for x in (labels, flipped))
    assert one == two


def test_toxicity_edges(spark):
    docs = helpers.documents(spark, extra=True)
    labels = spark.createDataFrame([(i, int(i in (2, 8))) for i in range(1, 12)] + [(1, None), (None, 1), (8, 0), (8, 1)], "doc_id long, toxic int")
    found = toxicity.classify(docs, labels)
    assert found.count() == docs.count() and all(0 <= r.score <= 1 for r in found.collect())
    none = labels.where("toxic is null")
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.0}
    assert toxicity.classify(helpers.empty(spark, docs), labels).count() == 0


def test_toxic_features():
    lexicon = toxicity.Lexicon({"trash": (50, 0), "lowe*": (40, 1)}, (100, 1000))
    texts = ["You are TRASH!! tr@sh i d i o t", "", "a lowental sooo word", "trash far away " + "x " * 30 + "you", "You are TRASH!! tr@sh i d i o t"]
    rows = toxicity.Measure(lexicon).of(texts)
    cell = {n: rows[:, k] for k, n in enumerate(toxicity.NAMES)}
    assert not rows[1].any() and (rows[0] == rows[4]).all()
    assert cell["disguised_share"][0] == 1 / 9 and cell["spelled"][0] == 3 and cell["near_pronoun"].tolist() == [2, 0, 0, 0, 2]
    assert cell["capitals"][0] == 1 / 9 and cell["mark_runs"][0] == 1 and cell["prefix_most"][2] > 2 > cell["prefix_most"][0] and cell["stretched"][2] == 1 / 4
    assert toxicity.Measure(toxicity.Lexicon({"trash": (1, 0)}, (9, 9)), without=1).of(["trash"])[0][toxicity.NAMES.index("weight_most")] == 0


def test_boosted_trees_fit_any_corner():
    dice = np.random.default_rng(2)
    rows = dice.random((4000, 4))
    label = ((rows[:, 0] > 0.5) != (rows[:, 1] > 0.3)).astype(float)
    model = toxicity.boosted(rows[:3000], label[:3000], np.ones(3000))
    model = toxicity.calibrated(model, rows[3000:], label[3000:], np.ones(1000))
    assert np.mean((model.scores(rows[3000:]) >= 0.5) == label[3000:]) > 0.97
