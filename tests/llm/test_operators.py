from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doseloom.llm.labels import day_of, ingredient_key, label_survivors, newest_labels, version_of
from doseloom.llm.leaks import find_leaks, remove_leaks, unsearchable
from doseloom.llm.mixing import mix
from doseloom.llm.names import THRESHOLD, Index, Words, accepted, edits, grams, letter_counts, map_names, sound
from doseloom.llm.pieces import cut_texts
from doseloom.llm.sentences import learn_starters, split_sentences
from doseloom.llm.survivors import Field, align, consensus, far, profile, survivors
from doseloom.llm.tokens import count_tokens, encoding

DOC = "doc_id long, text string, source string"


# survivors


def test_align_keeps_columns():
    assert align(["a", "b", "c"], ["a", "x", "b", "c"]) == [(1, 0, "a"), (1, 1, "x"), (2, 0, "b"), (3, 0, "c")]
    assert align(["a", "b"], []) == [] and align([], ["a"]) == [(0, 1, "a")]


def test_align_takes_least_edits_at_any_length():
    """Long values that differ at both ends: 2,200 common tokens, one place further."""
    guide = [f"t{i}" for i in range(2_201)]
    other = [*guide[1:], "end"]
    assert align(guide, other) == [*((i, 0, t) for i, t in enumerate(guide[1:], 2)), (2_201, 1, "end")] and far(guide, other) == 2
    values = {" ".join(guide): [1.5, 3], " ".join(other): [1.0, 1], " ".join(["s", *guide[2:], "end"]): [1.0, 2]}
    assert consensus(values, "sum") == " ".join(other)


def test_align_equals_the_whole_table(monkeypatch):
    import random

    import doseloom.llm.survivors as module

    def plain(x, y):
        cost = [[i + j if not i * j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                cost[i][j] = min(cost[i - 1][j - 1] + (x[i - 1] != y[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
        i, j, out = len(x), len(y), []
        while j:
            if i and cost[i][j] == cost[i - 1][j - 1] + (x[i - 1] != y[j - 1]):
                out.append((i, True))
                i, j = i - 1, j - 1
            elif i and cost[i][j] == cost[i - 1][j] + 1:
                i -= 1
            else:
                out.append((i, False))
                j -= 1
        return cost[-1][-1], out[::-1]

    rng = random.Random(2)
    for block in (256, 1, 3):
        monkeypatch.setattr(module, "BLOCK", block)
        for _ in range(1_000):
            x, y = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
            x, y = ["s", *x, "u"], ["v", *y, "w"]  # nothing shared at the ends
            edits, places = plain(x, y)
            got = align(x, y)
            assert far(x, y) == edits and [(at, not sub) for at, sub, _ in got] == places and [t for *_, t in got] == y


def test_size_of_a_group_changes_nothing(spark, monkeypatch):
    """Sums of weights that lie halfway between two roundings, ranks that are no number, records repeated with other weights."""
    import doseloom.llm.survivors as module

    nan = float("nan")
    rows = [("half", "r1", "alpha", 2.0, 2.0**-10), ("half", "r2", "beta", 3.0, 0.000976562), ("nan", "r1", "alpha", nan, 1.0), ("nan", "r2", "beta", 2.0, 1.0), ("nan", "r3", "beta", None, 1.0)]
    rows += [("again", "r1", "alpha", 1.0, 0.5), ("again", "r1", "alpha", 1.0, 3.0), ("again", "r2", "beta", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, id string, v string, t double, w double").coalesce(1)
    fields = {"v": Field(F.col("t"), vote="sum", weight=F.col("w")), "x": Field(F.col("t"), value=F.col("v"))}
    for large in (2_000, 1):
        monkeypatch.setattr(module, "LARGE", large)
        got = {r.g: (r.v, r.x) for r in survivors(df, "g", fields, "id").collect()}
        assert got == {"half": ("beta", "beta"), "nan": ("beta", "alpha"), "again": ("alpha", "beta")}


def test_majority_and_rank(spark):
    rows = [("k", "Acme Forte 5", 1), ("k", "Acme Forte 5 mg", 2), ("k", "Acme Forte 5 mg", 3), ("k", "Acne Forte 5 mg", 9), ("k", None, 10), ("s", None, 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "g string, v string, t int")
    got = {r.g: r for r in survivors(df.withColumn("w", F.col("v")), "g", {"v": Field(F.col("t"), vote="sum"), "w": Field(F.col("t"))}).collect()}
    assert set(got) == {"k", "s"} and got["k"].v == "Acme Forte 5 mg" and got["k"].w == "Acne Forte 5 mg" and got["k"].n_records == 5
    assert got["s"].v is None
    assert survivors(df.limit(0), "g", {"v": Field(F.col("t"))}).count() == 0


def test_columns_decide_between_values():
    """No value has a majority, but each of its tokens has; the newest value strays in one column."""
    values = {"acme forte 5 mg": [1.0, 1], "acme forte 10 mg": [1.0, 2], "acme fort 10 mg": [1.0, 3], "acne forte 10 mg tab": [1.5, 4]}
    assert consensus(values, "sum") == "acme forte 10 mg" and consensus(values, "rank") == "acne forte 10 mg tab"
    assert profile([(2.0, 2, "a c"), (1.0, 1, "a b c"), (1.0, 0, "a b c d")], "sum") == ["a", "b", "c", "d"]


def test_recent_labels_outvote_a_newest_one_that_strays(spark):
    u = "11111111-2222-3333-4444-555555555555"
    old = [(f"o{i}", u, "1", "20000101", ["x"], ["Acmene Old"]) for i in range(6)]
    new = [(f"n{i}", u, "1", "20240101", ["x"], ["Acmene Forte"]) for i in range(2)]
    got = label_survivors(spark.createDataFrame([*old, *new, ("z", u, "1", "20240601", ["x"], ["Acmene Frote"])], LABEL)).first()
    assert got.brand_names == "Acmene Forte" and got.label_id == "z" and got.n_records == 9


def test_spread_groups_give_the_same(spark, monkeypatch):
    import random

    import doseloom.llm.survivors as module

    rng = random.Random(5)
    words = "alpha beta gamma delta 5 10 mg".split()
    rows = [(rng.choice("abc"), f"r{rng.randrange(150)}", " ".join(rng.sample(words, rng.randint(1, 5))), float(rng.randrange(40)), rng.choice([0.5, 1.0, 2.0])) for _ in range(300)]
    rows += rows[:20] + [("a", "r999", None, None, 1.0), ("d", None, "alpha", 1.0, 1.0), ("e", "r1", "alpha", None, None), ("e", "r2", "beta", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, id string, v string, t double, w double")
    fields = {"v": Field(F.col("t"), vote="sum", weight=F.col("w")), "x": Field(F.col("t"), value=F.col("v")), "y": Field(F.col("t"), value=F.col("v"), valid=F.col("v").contains("mg"))}
    for record in ("id", None):
        monkeypatch.setattr(module, "LARGE", 2_000)
        want = sorted(map(str, survivors(df, "g", fields, record).collect()))
        monkeypatch.setattr(module, "LARGE", 1)
        assert sorted(map(str, survivors(df, "g", fields, record).collect())) == want and len(want) == (4 if record else 5)


def test_hot_group(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("g"), F.concat(F.lit("name "), F.col("id")).alias("v"), F.col("id").alias("t"))
    got = {r.g: r.v for r in survivors(df, "g", {"v": Field(F.col("t"))}).collect()}
    assert got["hot"] == f"name {19998}"


LABEL = "label_id string, set_id string, version string, effective_time string, ingredient_set array<string>, brand_names array<string>"


def test_labels(spark):
    u = "11111111-2222-3333-4444-555555555555"
    rows = [("a", u.upper(), "2", "20200101", ["x", "Y"], ["B"]), ("b", "N/A", "v10", "2020-01-01", ["y; X "], None), ("b", "N/A", "v10", "2020-01-01", ["y; X "], None), ("c", None, "3", "99999999", ["X", "y", None], []), ("d", u, "1", None, ["z"], []), ("e", u, "1", None, None, []), ("f", u, None, "", [" "], [])]
    got = newest_labels(spark.createDataFrame(rows, LABEL)).collect()
    assert [(r.ingredient_key, r.label_id, r.set_id) for r in got] == [("X|Y", "b", u)]
    assert label_survivors(spark.createDataFrame(rows, LABEL), False).count() == 2
    assert newest_labels(spark.createDataFrame([], LABEL)).count() == 0


def test_notations(spark):
    df = spark.createDataFrame([("20240229",), ("20230229",), ("2024/02/29",), ("29 Feb 2024",), ("20240229000000",), ("pending",), (None,)], "t string")
    assert [str(r.d) for r in df.select(day_of(F.col("t")).alias("d")).collect()] == ["2024-02-29", "None", "2024-02-29", "2024-02-29", "2024-02-29", "None", "None"]
    v = spark.createDataFrame([("012",), ("v7",), (" 3.0",), ("draft",), (None,)], "t string")
    assert [r.d for r in v.select(version_of(F.col("t")).alias("d")).collect()] == [12, 7, 3, 0, 0]
    k = spark.createDataFrame([(["b / a", "A  "],), ([],), (None,)], "t array<string>")
    assert [r.d for r in k.select(ingredient_key(F.col("t")).alias("d")).collect()] == ["A|B", "", ""]


# sentences


def test_split_sentences(spark):
    df = spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (2, None), (3, ""), (4, "x" * 300_000)], "id long, text string")
    assert split_sentences(df).count() == 5 and split_sentences(df, keys=["id"]).count() == 3
    assert split_sentences(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_sentences(df.withColumnRenamed("id", "sent_no"))
    assert "s_sent_no" in split_sentences(df.withColumnRenamed("id", "sent_no"), prefix="s_").columns


def test_words_written_small_that_begin_sentences(spark):
    """Learned after ends that leave no doubt, they begin sentences after a closing quote or an abbreviation too; other words don't."""
    plain = [f"It fell by {i}. codatolane was new. Then it rose and codatolane stayed. The end and so on." for i in range(5)]
    odd = ['He asked: "Is it safe with it?" codatolane was stable.', '"Stop it. Call us." and most did so.', "It fell over 3 h. codatolane was new.", "It fell for 3 h. and rose."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*plain, *odd, None, ""])], "id int, text string")
    known = learn_starters(df.select("text"))
    assert len(known) == 1
    count = lambda x: {r.id: r["count"] for r in x.groupBy("id").count().collect()}
    old, new = count(split_sentences(df)), count(split_sentences(df, starters=known))
    assert [(old[i], new[i]) for i in range(5, 9)] == [(1, 2), (1, 1), (1, 2), (1, 1)] and all(old[i] == new[i] == 4 for i in range(5))
    assert len(learn_starters(df.select("text").limit(0))) == 0 and split_sentences(df.limit(0), starters=known).count() == 0
    # counts of any split of the rows are the same
    assert list(learn_starters(df.where("id % 2 = 0").select("text"), df.where("id % 2 = 1").select(F.col("text").alias("t")))) == list(known)


# names


def test_leading_names():
    words = Words(["acmen", "acmen forte", "acmen plus", "potassium chloride", "sodium", "st john wort", "insulin glargine recombinant"])
    assert words.leading("20 mg Acmené® (Other) tabs b.i.d.") == "acmene"
    assert words.leading("Rx: ACMEN forte 5mg daily") == "acmen forte" and words.leading("acmen fotre 5 mg") == "acmen fotre" and words.leading("??? 5 mg") == ""
    for own in ("potassium chloride", "sodium", "st john wort", "insulin glargine recombinant"):
        assert words.leading(own) == words.leading(f"{own} 20 mg tablets daily") == own
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "abcdef", 2) == 3


def best(index, name):
    return accepted(*index.find([name])[0])[0]


def test_index_against_brute_force():
    keys = ["trazodone", "trazodone forte", "metformin", "metformax", "lisinopril"]
    index, words = Index(list(range(5)), keys), Words(keys)
    for typed, want in [("trazodne", 0), ("trazodone frote", 1), ("metformni", 2), ("lysinopryl", 4), ("aspirin", None), ("", None)]:
        assert best(index, words.leading(typed)) == want, typed


def test_cosines_by_hand():
    """Sums over the inverted lists, dense and sparse, equal the cosine of the two weighted bags."""
    keys = ["abcde", "abcxy", "zzq", "abc"]
    index = Index(list(range(4)), keys)

    def vector(name):
        bag = {g: c * index.weights.of(np.array([g], np.uint64))[0] for g, c in Counter(grams([name])[1].tolist()).items()}
        return bag | {-1 - i: c * index.letter_weights[i] for i, c in enumerate(letter_counts([name])[0]) if c}

    def cosine(a, b):
        x, y = vector(a), vector(b)
        return sum(w * y.get(g, 0) for g, w in x.items()) / (sum(w * w for w in x.values()) * sum(w * w for w in y.values())) ** 0.5

    letter_pairs = lambda name: {w[i : i + 2] for w in [f"^{name}$"] for i in range(len(w) - 1)} | {f"{w[i]}_{w[i + 2]}" for w in [f"^{name}$"] for i in range(len(w) - 2)}
    assert [len(set(grams([n])[1].tolist())) for n in ("abcab", "a", "ab ab")] == [len(letter_pairs("abcab")), len(letter_pairs("a")), len(letter_pairs("ab"))]
    for names in (["abcdf"], ["zzz"], ["abcdf", "abq", "qqq", "zz"]):
        name, entry, value, top = index.scores(names)
        assert top.tolist() == pytest.approx([max(value[name == i], default=0) for i in range(len(names))])
        for i, j, v in zip(name, entry, value):
            assert v == pytest.approx(cosine(names[i], index.sounds[j]))
    many = Index(list(range(400)), [*keys, *(f"{a}{b}{c}w" for a in "klmnop" for b in "rstuvx" for c in "ghijkmnopqr")][:400])
    assert {(i, j): pytest.approx(v) for i, j, v in zip(*many.scores(["abcdf"])[:3])} == {(0, j): v for i, j, v in zip(*many.scores(["zz", "abcdf"])[:3]) if i == 1}


def test_entry_behind_many_more_alike():
    """Two slips break most of a short name's letter pairs: entries with four slips and more come first by cosine."""
    others = [a + b + c + d + e for a in "bghj" for b in "aeou" for c in "klmst" for d in "aeou" for e in "xz"]
    keys = ["doprina", *(a + b + "efprnia" for a in "bghjt" for b in "klm"), *others]
    index = Index(list(range(len(keys))), keys)
    _, entry, cosine, _ = index.scores([sound("dfprnia")])
    own = cosine[entry == index.keys.index("doprina")][0]
    assert (cosine > own).sum() >= 12 and own >= THRESHOLD and best(index, "dfprnia") == 0


def test_blocks_do_not_change_results(spark, monkeypatch):
    """A near tie is refused and a sister brand is found, whichever blocks the entries lie in."""
    import doseloom.llm.names as module

    keys = ["lisinopril", "lisinapril", "acmen", "acmen forte", "abcdef", "abcdeg", "potassium chloride"]
    names = spark.createDataFrame(list(enumerate(keys)), "name_id long, name_key string")
    typed = ["lisinipril", "lisinoprol", "acmen frote", "acmen", "abcdeh", "abcdee", "Potassium Chloride 20 mEq", "zzzz", None]
    df = spark.createDataFrame(list(enumerate(typed)), "id int, v string")
    want = {r.id: (r.name_id, round(r.name_score, 6)) for r in map_names(df, "v", names).collect()}
    assert want[0][0] == -1 and [want[i][0] for i in (1, 2, 3, 6, 7, 8)] == [0, 3, 2, 6, -1, -1]
    for size in (1, 2, 3):
        monkeypatch.setattr(module, "BLOCK_ENTRIES", size)
        assert {r.id: (r.name_id, round(r.name_score, 6)) for r in map_names(df, "v", names).collect()} == want


def test_map_names(spark, monkeypatch):
    names = spark.createDataFrame([(1, "trazodone"), (2, "metformin"), (3, None), (None, "x")], "name_id long, name_key string")
    df = spark.createDataFrame([(1, "Trazodne 5 mg"), (1, "Trazodne 5 mg"), (2, None), (3, ""), (4, "z" * 200_000), (5, "metformin")], "id long, v string")
    want = [(1, 1), (1, 1), (2, -1), (3, -1), (4, -1), (5, 2)]
    assert sorted((r.id, r.name_id) for r in map_names(df, "v", names).collect()) == want
    import doseloom.llm.names as module

    monkeypatch.setattr(module, "BLOCK_ENTRIES", 1)
    assert sorted((r.id, r.name_id) for r in map_names(df, "v", names).collect()) == want
    assert map_names(df.limit(0), "v", names).count() == 0 and map_names(df, "v", names.limit(0)).where("name_id <> -1").count() == 0
    with pytest.raises(ValueError):
        map_names(df.withColumnRenamed("id", "name_id"), "v", names)


# leaks


WORDS = [f"word{i}" for i in range(400)]
ITEM = " ".join(WORDS[:40])


def leaks(spark, *texts, item=ITEM):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id for r in find_leaks(docs, spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")).collect()}


def test_leaks(spark):
    pad = " ".join(WORDS[100:300])
    half, less = " ".join(WORDS[10:30]), " ".join(WORDS[10:26])
    changed = " ".join("other" if i % 10 == 9 else w for i, w in enumerate(WORDS[:40]))
    broken = " ".join("other" if i % 6 == 5 else w for i, w in enumerate(WORDS[:40]))
    styled = ITEM.upper().replace(" ", " - ").replace("O", "Ö")
    got = leaks(spark, f"{pad} {ITEM}", f"{half} {pad}", f"{pad} {less} {pad}", f"{pad}, {changed}", broken, styled, None, "", ITEM + " " + ITEM)
    assert got == {0, 1, 3, 5, 8}


def test_leaks_with_changes_near_the_ends(spark):
    pad, item = WORDS[100:300], WORDS[:42]
    part = lambda n, *at: " ".join([*pad, *("other" if i in at else w for i, w in enumerate(item[:n])), *pad])
    # 21 of 42 words suffice; the last two are too short, and changed in too many places
    assert leaks(spark, part(21, 2), part(21, 18), part(22, 3, 17), part(24, 6, 12, 18), part(18, 2), part(24, 4, 9, 14, 19), item=" ".join(item)) == {0, 1, 2, 3}


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "keep Away, from heat!"), (2, "away from"), (3, "heat"), (4, "遠ざける")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "away from heat"), (2, "HEAT"), (3, "遠ざける"), (4, " - "), (5, None), (None, "x")], "item_id long, text string")
    assert sorted((r.item_id, r.doc_id) for r in find_leaks(docs, items).collect()) == [(1, 1), (2, 1), (2, 3), (3, 4)]
    assert sorted((r.item_id or 0, r.reason) for r in unsearchable(items).collect()) == [(0, "null id"), (4, "no word"), (5, "null text")]


def test_leaks_in_scripts_without_spaces(spark):
    item = "再採点の後、単独の誘導薬が別成分を指し、廃止頁の注が間隔を定めていない。鍵を開く"
    assert leaks(spark, f"前置き。{item}後", "再採点の後、関係のない文が続く長い文章", item=item) == {0}


def test_leaks_with_empty_tables_and_blocks(spark, monkeypatch):
    import doseloom.llm.leaks as module

    docs = spark.createDataFrame([(1, f"x {ITEM}"), (1, f"x {ITEM}"), (2, "clean text"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, " ".join(WORDS[50:90]))], "item_id long, text string")
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0
    monkeypatch.setattr(module, "SET_CHARS", 200)
    assert [(r.item_id, r.doc_id) for r in find_leaks(docs, items).collect()] == [(7, 1)]
    cleaned = {r.doc_id: r.text for r in remove_leaks(docs, items).collect()}
    assert cleaned[1].strip() == "x" and cleaned[3] is None
    assert sorted(r.doc_id for r in remove_leaks(docs, items, how="documents").collect()) == [2, 3]


# mixing


TARGET = "source string, target_share double, max_repeats int"


def test_mixture_reaches_its_shares(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(id % 20 + 5 as int))").alias("text"), F.expr("case when id % 3 = 0 then 'hot' when id % 30 = 1 then 'small' when id % 100 = 2 then null else 'mid' end").alias("source"))
    targets = spark.createDataFrame([("hot", 0.5, 2), ("small", 0.2, 3), ("mid", 0.3, 1), ("absent", 0.0, 1)], TARGET)
    mixture = mix(docs, targets, block_tokens=64)
    report = {r.source: r for r in mixture.report.collect()}
    total = sum(r.target_tokens for r in report.values())
    assert report["small"].short and report["small"].repeats == 3 and report["small"].placed_tokens == pytest.approx(report["small"].supply_tokens * 3, rel=0.01)
    for s in ("hot", "mid"):
        assert not report[s].short and report[s].placed_tokens == pytest.approx(report[s].target_tokens, abs=0.02 * total)
    rows = mixture.rows
    assert rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert rows.groupBy("doc_id", "repeat_no").count().where("count > 1").count() == 0
    first = rows.where("slot <= 64").groupBy("source").agg(F.countDistinct("slot").alias("n")).collect()
    assert {r.source: r.n for r in first}["hot"] == pytest.approx(32, abs=2)


def test_mixture_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y z", None), (4, "x y", "b"), (4, "x y", "b")], DOC)
    targets = spark.createDataFrame([("a", 0.5, None), ("b", 0.5, 1)], TARGET)
    report = {r.source: r for r in mix(docs, targets).report.collect()}
    assert report["a"].supply_tokens == 0 and report["a"].short and report["b"].supply_tokens == 4
    assert mix(docs.limit(0), targets).rows.count() == 0
    with pytest.raises(ValueError):
        mix(docs, targets.union(targets))


# pieces


def test_long_word_within_the_limit_is_one_piece():
    import numpy as np
    import pyarrow as pa

    from doseloom.llm.codepoints import blocks
    from doseloom.llm.pieces import SLICE, cut_block
    from doseloom.llm.tokens import counter

    word = "information" * 60
    c = counter()
    limit = len(c.encode(word))
    assert sum(len(c.encode(word[i : i + SLICE])) for i in range(0, len(word), SLICE)) > limit
    for block in blocks(pa.array([word])):
        (_, begin, _, tokens, _), = cut_block(block, limit, 8, c)
        assert len(begin) == 1 and np.array_equal(tokens, [limit])


def test_cut_texts(spark):
    df = spark.createDataFrame([(1, "One two three. " * 300), (1, "One two three. " * 300), (2, None), (3, ""), (4, "short")], "doc_id long, text string")
    got = cut_texts(df, with_text=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[2]) == len(by[3]) == len(by[4]) == 1 and max(r.n_tokens for r in got) <= 512
    text = "One two three. " * 300
    assert all(text[r.start_char : r.end_char] == r.piece_text for r in by[1]) and len({(r.piece_no, r.start_char) for r in by[1]}) * 2 == len(by[1])
    assert cut_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cut_texts(df.withColumnRenamed("doc_id", "piece_no"))
    with pytest.raises(ValueError):
        cut_texts(df, limit=10, overlap=6)
    assert {r.n_tokens for r in count_tokens(df).where("doc_id = 4").collect()} == {len(encoding().encode_ordinary("short"))}


def test_cuts_against_every_word(spark):
    """Prose, a text without sentences and lists: the boundaries that are looked at hold the best of all words."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    prose = " ".join(" ".join(word() for _ in range(rng.randint(4, 14))).capitalize() + "." for _ in range(120))
    rows = [(1, prose), (2, " ".join(word() for _ in range(900))), (3, "\n".join(f"- {word()} {word()}" for _ in range(300))), (4, prose[:2500] + " ".join(word() for _ in range(400)) + prose)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, cut_texts(df).collect())) == sorted(map(str, cut_texts(df, exact=True).collect()))
