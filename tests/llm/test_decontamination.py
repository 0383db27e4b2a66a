import re

import pytest

from ledgerloom.llm.decontamination import NUMBER_WORDS, UNIT_WORDS, contaminated


def sentences(text):
    """[[(word, its two readings)]]: a reading is a placeholder's name, or the lower-cased word."""
    out, fresh = [], True
    for raw in (text or "").split():
        word = re.sub(r"^[^\w$€£%+-]+|[^\w%]+$", "", raw)
        if fresh:
            out.append([])
        if word:
            low, own = word.lower(), out[-1]
            after_number = (own or (len(out) > 1 and out[-2])) and (own or out[-2])[-1][1][0] == "<number>"
            number = r"[-+]?[$€£]?[0-9][0-9.,/]*"
            if re.fullmatch(number, word) or low in NUMBER_WORDS:
                kinds = ("<number>",) * 2
            elif low in UNIT_WORDS and after_number:
                kinds = ("<unit>",) * 2
            elif any(re.fullmatch(number + re.escape(u), low) for u in UNIT_WORDS):
                kinds = ("<number><unit>",) * 2
            elif word[0].isupper() and word.upper() != word:
                kinds = ("<name>" if own else low, "<name>")
            else:
                kinds = (low, low)
            own.append((word, kinds))
            fresh = False
        fresh = fresh or bool(re.search(r"[.!?:;]$|[.!?][\"')»”]$", raw))
    return [x for x in out if x]


def slot(kind):
    return kind.startswith("<")


def windows(text, width):
    """{(start, key): values}: all that a text's windows of that width are looked for by."""
    words = [x for own in sentences(text) for x in own]
    out = {}
    for i in range(len(words) - width + 1):
        for reading in (0, 1):
            kinds, n = [k[reading] for _, k in words[i : i + width]], width
            if sum(map(slot, kinds[:width])) > width // 2:
                out[i, tuple(w.lower() for w, _ in words[i : i + width])] = []
                while i + n < len(words) and sum(not slot(k) for k in kinds) < width - width // 2:
                    kinds.append(words[i + n][1][reading])
                    n += 1
                if sum(not slot(k) for k in kinds) < width - width // 2:
                    continue
            out[i, tuple(kinds[:n]) + (("wide",) if n > width else ())] = [w for (w, _), k in zip(words[i : i + n], kinds, strict=False) if slot(k)]
    return out


def brute(docs, items, window=6, least=0.5, shortest=5):
    out = []
    for d, text in docs:
        for i, question in items:
            size = sum(map(len, sentences(question)))
            if not size:
                continue
            covered = set()
            if size < shortest:
                whole = [w.lower() for s in sentences(question) for w, _ in s]
                if whole in [[w.lower() for w, _ in s] for s in sentences(text)]:
                    covered = set(range(size))
            else:
                mine, theirs = windows(question, min(window, size)), windows(text, min(window, size))
                places = {}
                for (p, key), values in theirs.items():
                    places.setdefault(key, []).append((p, values))
                alignments = {}
                for (q, key), values in mine.items():
                    n = len(key) - (key[-1] == "wide")
                    at = [q + j for j in range(n) if slot(key[j])] if values else []
                    for p, other in places.get(key, []):
                        kinds = [k for k in key[:n] if slot(k)] if values else []
                        alignments.setdefault(p - q, []).append((q, n, list(zip(at, values, other, kinds, strict=True))))
                for hits in alignments.values():
                    votes = {}  # for each value, with whether it is a name, the places of each value of the document
                    for place, a, b, kind in {x for _, _, pairs in hits for x in pairs}:
                        votes.setdefault((a, kind == "<name>"), {}).setdefault(b, set()).add(place)
                    best = {a: [b for b in by if all(len(by[c]) < len(by[b]) for c in by if c != b)] for a, by in votes.items()}
                    best |= {(a, name): list(by) for (a, name), by in votes.items() if not name and len(by) == 2}
                    named = all(own for (_, name), own in best.items() if name)
                    for q, n, pairs in hits:
                        if all(a == b for _, a, b, _ in pairs) or (named and all(b in best[a, kind == "<name>"] for _, a, b, kind in pairs)):
                            covered |= set(range(q, q + n))
            if covered and len(covered) / size >= least:
                out.append((d, i, len(covered) / size))
    return sorted(out)


ITEMS = [
    (1, "Yesterday young Tom bought 3 ripe apples and 2 km of rope, then Tom gave 3 apples back to Ann at noon."),
    (2, "name the largest river that flows through the old town"),
    (3, "too short text"),
    (4, None),
    (5, "five words in this item"),
]
DOCS = [
    (1, "Intro. Yesterday young Bob bought 7 ripe apples and 5 km of rope, then Bob gave 7 apples back to Eve at noon. End"),
    (2, "Intro. Yesterday young Bob bought 7 ripe apples and 5 km of rope, then Max gave 9 apples back to Eve at noon. End"),
    (3, "He asked: name the largest river that flows through the old town, please"),
    (4, "name the largest river of all and nothing else here"),
    (5, None), (6, ""), (7, "5 6 7 8 9 10 11 12 13"), (8, "so five words in this item stand here " + "filler word " * 5000),
]


def found(spark, docs, items, **k):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    rows = contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"), **k).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in rows) == brute([(r.doc_id, r.text) for r in docs.collect()], list(enumerate(items)), **k)
    return {(r.doc_id, r.item_id): r.coverage for r in rows}


def test_planted(spark):
    docs = spark.createDataFrame([(i, t, 9) for i, t in DOCS], "doc_id bigint, text string, item_id int").repartition(3)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, doc_id string")
    out = contaminated(docs, items)
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in out.collect())
    assert got == brute(DOCS, ITEMS)
    assert [(d, i) for d, i, _ in got] == [(1, 1), (3, 2), (8, 5)]
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0


def test_rows_are_judged_apart(spark):
    """Halves of an item in rows that share an id, or have none, do not add up; repeated rows are reported each."""
    left, right = "Yesterday young Tom bought 3 ripe apples and", "of rope, then Tom gave 3 apples back to Ann"
    rows = [(None, left), (None, right), (7, left), (7, right), (None, DOCS[0][1]), (None, DOCS[0][1]), (3, DOCS[2][1]), (3, DOCS[2][1])]
    items = [*ITEMS, (None, ITEMS[1][1]), (2, ITEMS[1][1])]
    out = contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((str(r.doc_id), str(r.item_id)) for r in out.collect()) == [("3", "2")] * 4 + [("3", "None")] * 2 + [("None", "1")] * 2


def test_table(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    docs = docs.where("doc_id % 4 = 0").union(spark.createDataFrame([(900 + r.item_id, "x y " + r.text, "en", "s", 1) for r in items.collect()], docs.schema))
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in contaminated(docs, items).collect())
    # the brute-force reading looks only at items that share some words with the document
    rows, questions = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    grams = {i: {key for _, key in windows(q, 6)} for i, q in questions}
    want = [x for d, t in rows for own in [{key for _, key in windows(t, 6)}] for x in brute([(d, t)], [(i, q) for i, q in questions if grams[i] & own])]
    assert got == sorted(want) and len(got) >= items.count()


def test_other_names_and_numbers(spark):
    item = "Tom has 12 apples. Tom gives 5 apples to Anna. How many apples does Tom have left?"
    again = "Eva has 9 apples. Eva gives 4 apples to Carl. How many apples does Eva have left?"
    mixed = "Eva has 9 apples. Max gives 4 apples to Carl. How many apples does Ann have left?"
    lower = "he asked me to name the largest river that flows through the old town"
    other = "Paris has 12 bridges. Nobody counts 5 of them. How old does it look?"
    got = found(spark, ["Now: " + again, mixed, lower, other], [item, "Name the largest river that flows through the old town."])
    assert got[0, 0] == 1 and set(got) == {(0, 0), (2, 1)}


def test_units_only_after_numbers(spark):
    item = "we walked in s curves over 5 km of sand and c came to k last"
    got = found(spark, [item.replace("5 km", "7 miles"), item.replace(" in ", " m "), "we walked h g curves over 5 km of dust and f came to w last"], [item])
    assert set(got) == {(0, 0), (1, 0)}


def test_values_that_differ_at_one_place(spark):
    item = "we bought 3 ripe apples at the old market and later sold 3 apples to some friends, then ate 3 more on the way home"
    verbatim = item.replace("sold 3", "sold 4")
    other = item.replace("3", "7").replace("sold 7", "sold 8")
    two = "we bought 3 ripe apples at the old market and later sold 5 pears to some friends on the way home"
    merged = two.replace("3", "4").replace("5", "4")
    assert {d for d, _ in found(spark, [verbatim, other], [item])} == {0, 1}
    assert found(spark, [merged], [two]) == {(0, 0): 1.0}


def test_one_value_becomes_two(spark):
    pens = "Mia buys 4 pens for 2 dollars each and 4 books for 9 dollars each. How much does Mia pay?"
    rows = "there are 5 rows of 5 marbles in a box and somebody counts them"
    many = "take 4 cups and 4 spoons and 4 forks and 4 knives then 4 bowls and so on"
    docs = [
        pens.replace("4 pens", "6 pens").replace("4 books", "7 books").replace("Mia", "Lea"), rows.replace("5 rows", "8 rows").replace("5 marbles", "6 marbles"),
        "take 1 cups and 2 spoons and 3 forks and 5 knives then 6 bowls and so on",
    ]
    got = found(spark, docs, [pens, rows, many])
    assert got == {(0, 0): 1.0, (1, 1): 1.0}


def test_items_dense_in_placeholders(spark):
    items = [
        "What Is The Capital Of France And Which River Flows Through It", "add 3 4 5 6 7 8 then take 9 10 11 12 13 away and add 14 15 16 17 18 more",
        "12 + 30 = 42, 5 cm 3 mm 2 m",
    ]
    docs = [
        "so he asked: " + items[0] + " today", "now " + items[1] + " again", "now add 30 40 50 60 70 80 then take 90 100 110 120 130 away and add 140 150 160 170 180 more again",
        "1 2 3 4 5 6 7 8 9 10 11 12 13", "it says 12 + 30 = 42, 5 cm 3 mm 2 m here", "it says 13 + 40 = 53, 6 cm 4 mm 3 m here",
    ]
    got = found(spark, docs, items)
    assert set(got) == {(0, 0), (1, 1), (2, 1), (4, 2)} and got[1, 1] == 1


def test_short_items(spark):
    items = ["What is 2+2?", "Paris", "five words in this item", "the end"]
    docs = ["Well. What is 2+2? Four.", "what is 2+2 now", "He lived in Paris for long", "Which town? Paris.", "PARIS", "So five words in this item stand", "This is the end of it. the END", None, "..."]
    assert set(found(spark, docs, items)) == {(0, 0), (3, 1), (4, 1), (5, 2), (6, 3)}


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    import random

    rng = random.Random(seed)
    pool = ["Tom", "Eva", "3", "4", "12", "km", "kg", "5km", "a", "the", "runs", "to", "ten", "Rome.", "of", "it.", "-", "and", "9?", "in"]
    items = [" ".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(12)]
    docs = []
    for _ in range(40):
        words = rng.choice(items).split()
        for k in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(pool)
        docs.append(" ".join([*rng.choices(pool, k=rng.randint(0, 8)), *words, *rng.choices(pool, k=rng.randint(0, 8))]))
    assert found(spark, docs, items)
