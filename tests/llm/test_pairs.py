"""Pair, name and near-copy operators against brute force on small rows."""

import itertools
import random
import unicodedata

from lectern.llm import components, cooccurrence, names, nearcopies


def brute(rows, n_min):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    pairs = {}
    for s in baskets.values():
        for p in itertools.combinations(sorted(s), 2):
            pairs[p] = pairs.get(p, 0) + 1
    return {p: n for p, n in pairs.items() if n >= n_min}, len(baskets)


def test_pair_table(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cooccurrence, "CELL", 3)
    monkeypatch.setattr(cooccurrence, "LONG", 9)
    rnd = random.Random(2)
    rows = [(rnd.randrange(30), min(19, int(rnd.expovariate(0.15)))) for _ in range(260)] + [(b, i) for b in (50, 51, 52) for i in range(14)] + [(None, 1), (1, None), (2, 3), (2, 3)]
    df = spark.createDataFrame(rows, "article_id long, entity_id long")
    b = cooccurrence.baskets(df, "article_id", "entity_id")
    want, n = brute(rows, 3)
    table = cooccurrence.PairTable(spark).updated(None, b)
    assert {(r.entity_a, r.entity_b): r.n_ab for r in table.associations(3).collect()} == want and table.baskets == n
    # An update equals a table built anew: basket 1 changes, 50 goes, 99 comes.
    changed = [(x, i) for x, i in rows if x not in (1, 50)] + [(1, 4), (1, 5), (99, 4), (99, 5)]
    old = b.where("basket in (1, 50)")
    new = spark.createDataFrame([(1, 4), (1, 5), (99, 4), (99, 5)], "basket long, item long")
    table = table.updated(old, new)
    want, n = brute(changed, 3)
    assert {(r.entity_a, r.entity_b): r.n_ab for r in table.associations(3).collect()} == want and table.baskets == n
    table.save(str(tmp_path))
    table = cooccurrence.PairTable.loaded(spark, str(tmp_path))
    scored = {(r.entity_a, r.entity_b): r.n_ab for r in table.associations(3).collect()}
    assert scored == want and table.baskets == n
    items = spark.createDataFrame([(4,), (5,)], "item long")
    assert {(r.entity_a, r.entity_b): r.n_ab for r in table.affected(items, 3).collect()} == {p: c for p, c in want.items() if {4, 5} & set(p)}
    empty = cooccurrence.PairTable(spark).updated(None, b.limit(0))
    assert empty.associations(1).count() == 0 and empty.baskets == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.v: r.c for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_names(spark):
    groups = [
        ["José Munasabre Tejada", "J. Munasabre", "Munasabre, José", "Pepe Munasabre", "José\xa0Munasabre", "Jose Munasabre-Tejada", "Munasabre Tejada, José", "Ing. José Munasbare"],
        ["Teresa Beatriz Munasabre Luna", "T. Munasabre", "TB Munasabre"],
        ["Banco Agrícola de Puderago", "banco agrícola de puderago", "Bco. Agric. Puderago", "«Banco Agrícola de Puderago»", "la Banco Agrícola de Puderrago"],
        ["Fundación Puderago para la Infancia", "Fund. Puderago p/ la Infancia"],
        ["Transportes Nadalosa, S.R.L.", "Transportes Nadalosa SRL", "Nadalosa, Transportes, S.R.L."],
        ["Monte Chefacimo", "Mte. Chefacimo", "Mun. de Monte Chefacimo"],
    ]
    rows = [(i, t, "PERSON" if k < 2 else "ORG") for k, g in enumerate(groups) for i, t in enumerate(g)] + [(1, None, "ORG"), (2, " ", None), (3, "José Munasabre Tejada", "GPE"), (4, "x" * 3000, "ORG"), (5, "José Munasabre Tejada", "PERSON")]
    found, clusters = names.variants(spark.createDataFrame(rows, "id long, text string, type string"))
    label = {r.text: r.c for r in found.join(clusters, found.key == clusters.v).collect()}
    for g in groups:
        assert len({label.get(t, t) for t in g}) == 1, g
    assert len({label[g[0]] for g in groups}) == len(groups)
    empty = spark.createDataFrame([], "id long, text string, type string")
    assert names.variants(empty)[1].count() == 0


def test_names_that_sound_alike_are_not_listed(spark, monkeypatch):
    """Names of one sound, none a typing of another, are not written out in pairs."""
    rnd, listed, compared = random.Random(5), [], names.compared
    family = lambda: "".join(c + rnd.choice("aeiou") for c in "bdrlntmps")
    texts = [f"Ana {w}" for w in sorted({family() for _ in range(300)})]
    monkeypatch.setattr(names, "compared", lambda pairs, found: listed.append(pairs.count()) or compared(pairs, found))
    found, clusters = names.variants(spark.createDataFrame([(i, t, "PERSON") for i, t in enumerate([*texts, texts[0].upper()])], "id long, text string, type string"))
    label = {r.text: r.c for r in found.join(clusters, found.key == clusters.v).collect()}
    assert label[texts[0]] == label[texts[0].upper()]
    assert sum(listed) < 10 * len(texts)


def test_typing_keys():
    """Typings of one word have a key in common, whatever their length."""
    rnd = random.Random(9)
    for size in [*range(3, 24), 40, 90]:
        for _ in range(60):
            word = "".join(rnd.choice("abcdeo") for _ in range(size))
            typed = word
            for _ in range(rnd.choice((1, 2))):
                at = rnd.randrange(len(typed))
                typed = rnd.choice((typed[:at] + typed[at + 1 :], typed[:at] + "x" + typed[at:], typed[:at] + "x" + typed[at + 1 :], typed[:at] + typed[at : at + 2][::-1] + typed[at + 2 :]))
            if typed != word and names.same_token(word, typed):
                assert names.typing_keys(word) & names.typing_keys(typed), (word, typed)


def test_names_against_all_pairs(spark, monkeypatch):
    """However common their words are, the accepted pairs are those of all pairs of spellings."""
    rnd = random.Random(11)
    given, family = "Ana Anna María Mario Carmen José Pepe Al Ali Jos Franc Francisco".split(), "Marte Martes Marta Munasabre Grovochutra Zilavupi Li Coop Peña Carmen".split()

    def typed(word):
        at = rnd.randrange(len(word))
        return rnd.choice([word] * 6 + [word[:at] + word[at + 1 :], word[:at] + "r" + word[at:], word[:1] + ".", word.upper()])

    people = {" ".join(typed(rnd.choice(x)) for x in rnd.choice(((given, family), (given, given, family), (given, family, family), (given, family, family, family), (family, given)))) for _ in range(260)}
    bodies = {f"{rnd.choice(('Banco', 'Bco.', 'Coop.', 'Fund.'))} {rnd.choice(('Agrícola', 'Agric.', 'de'))} {typed(rnd.choice(family))}{rnd.choice(('', ' Peña', ' Marte Li'))}" for _ in range(60)} | {"Li Bo", "li bo", "LI-BO", "x"}
    rows = [(i, t, "PERSON" if t in people and rnd.random() < 0.8 else "ORG") for i, t in enumerate(sorted(people | bodies))]
    found = names.staged(names.spellings(spark.createDataFrame(rows, "id long, text string, type string")), "test-names")
    each = [(r.key, list(r.tokens), r.person, r.rare, list(r.core)) for r in found.collect()]
    want = set()
    for (a, x, p, r, v), (b, y, q, s, w) in itertools.permutations(each, 2):
        if names.verdict(x, p, r, y, q, s) is not None:
            (m, crossed), (n, also) = names.meeting(x, p, v), names.meeting(y, q, w)
            shared = {(m[k], n[k]) for k in m.keys() & n.keys()}
            want |= {(False, a, b)} if a < b and (crossed & also or (True, True) in shared) else set()
            want |= {(True, a, b)} if (True, False) in shared else set()
    assert {lacks for lacks, *_ in want} == {True, False}
    for common in (2, 32, 10**6):
        monkeypatch.setattr(names, "COMMON", common)
        got = {(r.lacks, r.a, r.b) for r in names.compared(names.met(found), found).collect()}
        assert got == want, (common, len(got), len(want))


def linked(spark, rows):
    """(classes, pairs, the comparable texts) of (id, text) rows."""
    keys, texts = map(list, zip(*rows))
    made = nearcopies.sketch_batch(keys, texts, nearcopies.letter_table()).to_pylist()
    sketch = spark.createDataFrame([tuple(r.values()) for r in made], nearcopies.SKETCH)
    return *nearcopies.links(sketch), {r["id"]: r["text"] for r in made}


def jaccard(x, y):
    p, q = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (x, y))
    return len(p & q) / len(p | q) if p | q else 0


def test_near_copies(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnoprstuvz") for _ in range(rnd.randrange(3, 9))) for _ in range(900)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice((6, 40, 150)))) for _ in range(40)]
    for t in texts[:25]:
        w = t.split()
        for _ in range(len(w) // 25 + 1):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper() + "!", "short", "", "longer one"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    classes, pairs, clean = linked(spark, rows)
    rep = {r.id: r.rep for r in classes.collect()}
    got = {(r.a, r.b) for r in pairs.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(set(rep.values())), 2) if jaccard(clean[a], clean[b]) >= 0.5}
    assert got <= want and len(got) >= 0.9 * len(want) and want
    assert rep[65] == rep[66] == rep[0] == 0 and 67 not in rep
    assert nearcopies.links(spark.createDataFrame([], nearcopies.SKETCH))[1].count() == 0


def test_groups_of_near_copies(spark):
    """Every pair of a group of near copies is found, whatever the size of the group."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvz") for _ in range(rnd.randrange(3, 9)))
    texts, group = [], {}
    for k, n in enumerate((8, 40, 120, 1000)):
        base = [word() for _ in range(150)]
        for _ in range(n):
            copy = list(base)
            for at in rnd.sample(range(150), 1 if n > 200 else 4):
                copy[at] = word() + "q"
            group[len(texts)] = k
            texts.append(" ".join(copy))
    classes, pairs, _ = linked(spark, [*enumerate(texts)])
    alone = {r.id for r in classes.where("id = rep").collect()}
    got = {(r.a, r.b) for r in pairs.collect()}
    for k in range(4):
        want = {(a, b) for a, b in itertools.combinations(sorted(alone), 2) if group[a] == group[b] == k}
        assert len(got & want) >= 0.999 * len(want), k
    assert all(group[a] == group[b] for a, b in got)


def test_recall_by_similarity(spark):
    """Pairs far above the threshold are found always, those just above it nearly always."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvz") for _ in range(rnd.randrange(3, 9)))
    texts = []
    for k in range(400):
        base = [word() for _ in range(rnd.choice((30, 80, 200)))]
        copy = [word() if rnd.random() < 0.01 * (k % 12) else w for w in base]
        texts += [" ".join(base), " ".join(copy)]
    classes, pairs, clean = linked(spark, [*enumerate(texts)])
    rep = {r.id: r.rep for r in classes.collect()}
    got = {(r.a, r.b) for r in pairs.collect()}
    sims = {(a, a + 1): jaccard(clean[a], clean[a + 1]) for a in range(0, len(texts), 2) if rep[a] != rep[a + 1]}
    high, low = ({p for p, s in sims.items() if lo <= s < hi} for lo, hi in ((0.65, 1), (0.5, 0.65)))
    assert len(high & got) >= 0.995 * len(high) and len(low & got) >= 0.95 * len(low) and len(low) > 20
    assert got <= {p for p, s in sims.items() if s >= 0.5}


def test_every_segment_has_deletion_neighbours():
    kept = [(k << 40) | (k << 20) for k in [3] * 7 + [5] * 3 + [6]]  # segments of seven, three and one runs
    kept = nearcopies.np.array([x | i << 10 for i, x in enumerate(kept)], dtype="uint64")
    np = nearcopies.np
    found, _ = nearcopies.band_signatures(kept, np.zeros(len(kept), dtype="int64"), np.array([5]))
    assert len(set(found.tolist())) == 1 + 7 + 1


def test_tiny_texts_on_both_sides(spark):
    """No pair with a tiny text is missed, whichever of its texts has the smaller id."""
    rnd = random.Random(11)
    texts = []
    for k in range(60):
        long = "".join(rnd.choice("abcdefghijklmnoprstuvz") for _ in range(rnd.choice((12, 40, 66))))
        n = len(long) * 2 // 3
        tiny = long[:n] + rnd.choice("wxy") + long[n + 1 :]
        texts += [long, tiny] if k % 2 else [tiny, long]
    texts += ["the same start " + t for t in texts]
    _, pairs, clean = linked(spark, [*enumerate(texts)])
    size = {i: len({t[k : k + 8] for k in range(len(t) - 7)}) for i, t in clean.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(clean), 2) if min(size[a], size[b]) < nearcopies.TINY and jaccard(clean[a], clean[b]) >= 0.5}
    got = {(r.a, r.b) for r in pairs.collect()}
    assert want <= got and len(want) > 20


def test_many_texts_are_hashed_at_once(monkeypatch):
    """Texts of any length have the runs they have alone, and one pass over the characters serves many texts."""
    np, rnd, letters = nearcopies.np, random.Random(12), nearcopies.letter_table()
    odd = "aab\u00e9\u00df\u03a3\u0130\u0301\u00bd\ufb01\ud55c\u0663 .\U0001d54f"
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(60))) for _ in range(300)] + ["a" * n for n in range(20)] + [""]
    codes = [nearcopies.comparable(t, letters) for t in texts]
    for text, c in zip(texts, codes):
        assert "".join(map(chr, c)) == "".join(x for x in unicodedata.normalize("NFKD", text.lower()) if x.isalnum())
    runs, sizes = nearcopies.distinct_runs(codes)
    assert sizes.tolist() == [len({tuple(c[k : k + 8].tolist()) for k in range(len(c) - 7)}) for c in codes]
    alone = [nearcopies.distinct_runs([c])[0] for c in codes]
    assert np.array_equal(runs, np.concatenate(alone)) and all((a[1:] > a[:-1]).all() for a in alone)
    passes, made = [], nearcopies.window_hashes
    monkeypatch.setattr(nearcopies, "window_hashes", lambda c: passes.append(1) or made(c))
    assert nearcopies.sketch_batch(list(range(len(texts))), texts, letters).num_rows == int((sizes > 0).sum())
    assert len(passes) <= len(texts) // 16


def test_names_meet_by_common_tokens(spark):
    """A token that is far more common than the rarest one of a spelling gives a block too, and so does one next to an edited initial."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)).title()
    crowd = [f"{word()} Gonzalez {word()}" for _ in range(60)] + [f"Francisco {word()} {word()}" for _ in range(60)]
    texts = ["Francisco Gonzalez", "Francisco Gonzalez Xurxo", "Maria Pelotari", "Xaria Pelotari"]
    found, clusters = names.variants(spark.createDataFrame([(i, t, "PERSON") for i, t in enumerate(texts + crowd)], "id long, text string, type string"))
    label = {r.text: r.c for r in found.join(clusters, found.key == clusters.v).collect()}
    assert label.get(texts[0], 0) == label.get(texts[1], 1)
    assert label.get(texts[2], 0) == label.get(texts[3], 1)


def test_a_torn_spelling_keeps_its_sure_variants(spark):
    """A spelling between two full names loses its pairs with these only, and one name with a typing error is not two."""
    sure, full = ["Maria Pelotari", "PELOTARI, Maria", "María Pelotari"], ["Maria Pelotari Diaz", "Maria Pelotari Ruiz"]
    typed = ["Teresa Munasabre", "Teresa Munasabre Gonzalez", "Teresa Munasabre Gomzalez"]
    found, clusters = names.variants(spark.createDataFrame([(i, t, "PERSON") for i, t in enumerate(sure + full + typed)], "id long, text string, type string"))
    label = {r.text: r.c for r in found.join(clusters, found.key == clusters.v).collect()}
    assert len({label.get(t, t) for t in sure}) == 1 and sure[0] in label
    assert len({label.get(t, t) for t in sure[:1] + full}) == 3
    assert len({label.get(t, t) for t in typed}) == 1


def test_names_do_not_hang_on_the_crowd(spark):
    """A spelling with an initial keeps its variant however many others share its block, and joins none if two people fit."""
    own, two = ["F. Gararubru", "Francisco Gararubru Marte"], ["T. Zomiluka", "Tomas Zomiluka Ruiz", "Tomas Zomiluka Pardo"]
    vowels = [a + b + c + d for a in "aou" for b in "aou" for c in "ao" for d in "ao"]
    crowd = [f"Felipe G{a}r{b}b{c}r{d} Luna" for a, b, c, d in vowels]
    near = [("Fund. Vepectagre para la Infancia", "ORG"), ("Fund. Vepechagre para la Infancia", "ORG")]
    for others in (crowd[:3], crowd):
        rows = [*((t, "PERSON") for t in own + two + others), *near]
        found, clusters = names.variants(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, type string"))
        c = {r.text: r.c for r in found.join(clusters.withColumnRenamed("v", "key"), "key").collect()}
        assert c[own[0]] == c[own[1]] and c[near[0][0]] == c[near[1][0]]
        assert two[0] not in c
