"""Line, sentence, language, leakage and tokenizer operators on small rows: brute force, round trips and defined edge cases."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import boilerplate, languages, leakage, repeats, sentences, tokenizer

SOURCES = "id long, domain string, locale string"
ARTICLES = "id long, source_id long, source_domain string, title string, content string"
tokens = pytest.mark.skipif(not os.path.isdir(tokenizer.TOKENIZER_DIR), reason="no tokenizer files")


def pages(n=12):
    rnd = random.Random(1)
    words = "sol mar luz rio pan voz paz flor casa monte puente barco".split()
    out = []
    for i in range(n):
        story = " ".join(f"{rnd.choice(words).title()} {' '.join(rnd.choice(words) for _ in range(9))} {i}{k}." for k in range(4))
        items = "\n".join(f"- {' '.join(rnd.choice(words) for _ in range(6))} {i}{k}" for k in range(2))
        out.append((i, 1, "S.example", f"T{i}", f"MENU\n\nFoto: {rnd.choice(words)} {i}\n{story}\nRelated\n{items}\n© 20{10 + i} Site. All rights reserved."))
    return out


def test_repeats_equal_brute_force(spark):
    rows = pages() + [pages()[0], (90, None, " WWW.s.example", None, "MENU\nMENU\nx"), (91, 1, None, None, None), (92, 1, None, None, ""), (None, 1, None, None, "MENU"), (93, None, None, None, "MENU")]
    a, s = spark.createDataFrame(rows, ARTICLES), spark.createDataFrame([(1, "s.example", "en_US")], SOURCES)
    digest = repeats.digests(a, s)
    nodes = repeats.repeated_nodes(digest)
    found = repeats.occurrences(digest, nodes).select("id", F.explode("hits.no").alias("n"))
    got = {(r.id, r.n) for r in found.collect()}
    lines = {i: c.split("\n") for i, _, _, _, c in rows if i is not None and c and i != 93}
    like = lambda x: re.sub(r"\d+", "0", " ".join(x.split()).lower())
    count = {}
    for i, ls in lines.items():
        for x in {like(x) for x in ls} - {""}:
            count[x] = count.get(x, 0) + 1
    want = {(i, k) for i, ls in lines.items() for k, x in enumerate(ls, 1) if like(x) and count[like(x)] >= 3 and count[like(x)] >= 0.2 * 15}
    assert got == want
    blocks = {r.h: r.block for r in repeats.blocks(repeats.occurrences(digest, nodes), nodes).collect()}
    assert len(blocks) == nodes.count()
    kept = {r.id: r.content for r in repeats.removed(a, found.withColumnRenamed("n", "line_no")).collect()}
    assert "MENU" not in kept[90] and kept[91] is None
    assert repeats.digests(a.limit(0), s).count() == 0


def test_template(spark):
    a, s = spark.createDataFrame(pages() + [(91, 1, None, None, None), (92, 1, None, None, "")], ARTICLES), spark.createDataFrame([(1, "s.example", "en_US")], SOURCES)
    body = {r.id: r.body for r in boilerplate.stories(a, s).collect()}
    assert set(body) == set(range(12)) | {92}
    story = next(x for x in pages()[0][4].split("\n") if x.endswith(".") and "©" not in x)
    assert body[0] == story and body[92] == ""
    assert boilerplate.stories(a.limit(0), s).count() == 0


def test_classes_decide(spark, monkeypatch):
    """A frequent token is template only with its class: an opening of stories has no end of its own, and no token stands alone."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(7))
    rows = [(i, 1, "S.example", "t", f"At a hearing called by {word()}, the {word()} {word()}.\nBy {word().title()} {word().title()}\nMore: {word()} {'S. A.' if i == 3 else word()}\nMENU") for i in range(20)]
    a, s = spark.createDataFrame(rows, ARTICLES), spark.createDataFrame([(1, "s.example", "en_US")], SOURCES)
    left = lambda: {r.id: r.body for r in boilerplate.stories(a, s).collect()}
    assert left() == {r[0]: r[4].split("\n")[0] for r in rows}
    monkeypatch.setattr(boilerplate, "MIN_TOKENS", 99)
    assert left() == {r[0]: r[4] for r in rows}


def test_stories_are_the_lines_that_are_no_furniture(spark, tmp_path):
    rows = pages() + [pages()[3], (91, 1, None, None, None), (92, None, None, None, "\n"), (93, 1, "s.example", None, "one.\n" * 5)]
    spark.createDataFrame(rows, ARTICLES).write.parquet(f"{tmp_path}/articles.parquet")
    spark.createDataFrame([(1, "s.example", "en_US")], SOURCES).write.parquet(f"{tmp_path}/sources.parquet")
    gone = {(r.id, r.line_no) for r in boilerplate.p5_found(spark, str(tmp_path)).collect()}
    want = {i: "\n".join(x.strip() for n, x in enumerate(c.split("\n"), 1) if x.strip() and (i, n) not in gone) for i, *_, c in rows if c is not None}
    assert {r.id: r.body for r in boilerplate.p5_stories(spark, str(tmp_path)).collect()} == want and gone


def test_sentences():
    model = {k: set() for k in sentences.KINDS} | {"title": {"Dr", "Av"}, "abbr": {"art", "S. A"}, "end": {"S. A"}, "number": {"Juni"}}
    cut = lambda x: sentences.split_line(x, model)
    assert cut("El Dr. Luna vio el art. 5. La Av. Los Pinos cerró.") == ["El Dr. Luna vio el art. 5.", "La Av. Los Pinos cerró."]
    assert cut("Compró a Lumar, S. A., hoy. Lumar, S. A. El resto no.") == ["Compró a Lumar, S. A., hoy.", "Lumar, S. A.", "El resto no."]
    assert cut("Am 8. Juni kam er. Es kostet 3.5 Euro.") == ["Am 8. Juni kam er.", "Es kostet 3.5 Euro."]
    assert cut("«No. Ya basta», dijo Ana. ¿Y hoy? ¡Sí!") == ["«No. Ya basta», dijo Ana.", "¿Y hoy?", "¡Sí!"]
    assert cut("「なぜ？今だ」と書いた。次の文。") == ["「なぜ？今だ」と書いた。", "次の文。"]
    assert cut("J. M. Luna llegó… y calló.Otro día") == ["J. M. Luna llegó… y calló.", "Otro día"]
    assert cut("  ") == [] and cut("MENU") == ["MENU"] and len(cut("Uno dos. " * 5000)) == 5000


def test_sentence_rows(spark):
    a = spark.createDataFrame([(1, "es", "Hola. Adiós.\n\n  x "), (2, "und", "")], "id long, lang string, content string")
    model = spark.createDataFrame([], "lang string, kind string, type string")
    assert sorted(map(tuple, sentences.units(a, model).collect())) == [(1, 1, "Adiós."), (1, 1, "Hola."), (1, 3, "x")]
    assert sentences.learn(a.limit(0)).count() == 0


def test_every_half_and_every_change_is_found():
    """Passages of 1 to 40 words: every qualifying part of them, wherever its words are changed, and nothing shorter."""
    rnd = random.Random(6)
    for n in range(1, 41):
        words = [f"w{i}" for i in range(n)]
        index = leakage.PassageIndex([words])
        least = -(-n // 2)
        for t in range(least, n + 1):
            for at in {0, (n - t) // 2, n - t}:
                inner, most = range(1, t - 1), t // 6
                changes = [(), *((i,) for i in inner if most)] + [tuple(rnd.sample(inner, k)) for k in range(2, most + 1) for _ in range(4)]
                changes += [tuple(t * (k + 1) // (most + 1) for k in range(most))]
                for c in changes:
                    text = ["x", *("z" if i in c else w for i, w in enumerate(words[at : at + t])), "y"]
                    assert index.found(" ".join(text)), (n, t, at, c)
        assert n < 2 or least < 2 or not index.found(" ".join(["x", *words[: least - 1], "y"]))


def test_cleaned_texts_hold_no_leak(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passages = [" ".join(word() for _ in range(12)) for _ in range(4)] + ["日本語の文章を確かめる問題です"]
    items = spark.createDataFrame([(k, p) for k, p in enumerate(passages)] + [(9, passages[0]), (10, None), (11, "")], "item_id long, passage string")
    texts = [f"Before, {passages[0].upper()} after.", f"{passages[1]} and {passages[1]}", "nothing here", None, "", f"前。{passages[4]}後", " ".join(passages[2].split()[:7])]
    docs = spark.createDataFrame([*enumerate(texts), (None, passages[0])], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.leaked_items) for r in leakage.cleaned(docs, items).collect()}
    assert set(got) == set(range(7)) and [got[k][1] for k in range(7)] == [2, 1, 0, 0, 0, 1, 1]
    assert got[0][0] == "Before,  after." and got[1][0] == " and " and got[2][0] == "nothing here" and got[3][0] is None and got[4][0] == "" and got[5][0] == "前。後" and got[6][0] == ""
    left = spark.createDataFrame([(k, t) for k, (t, _) in got.items()], "doc_id long, text string")
    assert leakage.leaks(left, items).count() == 0
    assert leakage.cleaned(docs, items.limit(0)).where("leaked_items > 0").count() == 0


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    passages = [[rnd.choice(vocabulary) for _ in range(30)] for _ in range(5)]
    docs, want = [], set()
    for i in range(60):
        p = rnd.randrange(5)
        n = rnd.choice((8, 12, 15, 20, 30))
        part = passages[p][:n]
        for at in range(5, n, 7):
            part = part[:at] + ["zz"] + part[at + 1 :] if i % 2 else part
        docs.append((i, " ".join([rnd.choice(vocabulary) for _ in range(40)] + [w.upper() + "," for w in part] + ["end"])))
        if n >= 15:
            want.add((i, p))
    items = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passages)] + [(9, None), (10, ""), (11, "...")], "item_id long, passage string")
    d = spark.createDataFrame(docs + [(90, None), (91, ""), (None, "x"), (92, "word " * 20000)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, items).collect()} == want
    assert leakage.leaks(d, items.limit(0)).count() == 0 and leakage.leaks(d.limit(0), items).count() == 0


@tokens
def test_tokenizer_round_trip(spark):
    texts = ["", None, "Hello  world's\n\n x", "naïve ½ Ⅷ x²", "日本語。 हिन्दी 🌊", "a\x1cb  c", "<|endoftext|>", "word " * 30000, "Hello  world's\n\n x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = tokenizer.encode(d)
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=tokenizer.PRE_TOKEN, mergeable_ranks=tokenizer.read_ranks(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), special_tokens={})
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in tokenizer.decode(ids).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokenizer.encode(d.limit(0)).count() == 0


@tokens
def test_languages_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = languages.segments(docs).groupBy("doc_id", "label").agg(F.collect_set("lang").alias("langs")).where(F.col("label").isNotNull()).collect()
    # About a tenth of the labels are wrong by design, so agreement has a ceiling; the scripts of the text have not.
    assert sum(r.label in r.langs for r in found) / len(found) > 0.85
    scripts = {"ru": "[а-я]", "hi": "[ऀ-ॿ]", "ar": "[؀-ۿ]", "ja": "[぀-ヿ]"}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    share = lambda p, t: len(re.findall(p, t)) / max(1, len(re.findall(r"[^\W\d_]", t)))
    single = [(r.langs[0], texts[r.doc_id]) for r in found if len(r.langs) == 1]
    told = [(lang, next((k for k, p in scripts.items() if share(p, t) > 0.3), None)) for lang, t in single]
    assert sum(k is None or k == lang for lang, k in told) / len(told) > 0.99
    assert [languages.label_code(x) for x in ("es_DO", "Español", "eng", "??", "", None, "xx", "日本語")] == ["es", "es", "en", None, None, None, None, "ja"]
    odd = spark.createDataFrame([(1, None, "es"), (2, "", None), (3, "... 🌊 12", None), (None, "hola", None)], "doc_id long, text string, lang string")
    assert languages.segments(docs.select("doc_id", "text", "lang").limit(300).unionByName(odd)).where(F.col("doc_id").isin(1, 2, 3) & (F.col("label") == "zz")).count() == 0


def test_runs_are_segmented_once(monkeypatch):
    """A run met again costs one look-up, and the score is still the sum over the words."""
    asked, plain = [], languages.piece_word
    model = languages.Segmenter({}, 1e-6)
    monkeypatch.setattr(languages, "piece_word", lambda run: asked.append(run) or plain(run))
    text = "Sol y sol; 日本 y sol _ÿ_ 12a"
    total, n = model.score(text)
    again, _ = model.score(text)
    words = languages.piece_words(text)
    assert n == len(words) and (again == total).all() and (abs(total - sum(model.forward(w)[1] for w in words)) < 1e-9).all()
    asked.clear()
    model.score(text + " sol")
    assert asked == [] and model.score("...")[1] == 0


def test_lines_without_the_digits_of_any_script():
    """White space and digits go, of whatever script, and a first word has one hash whether it is met before or not."""
    rnd = random.Random(8)
    digits = "".join(chr(c) for c in range(0x110000) if chr(c).isdecimal())
    signs = digits + "abcÉß  \t\xa0“—½²مहकक्न中文" * 20
    words: dict = {}
    for line in [*digits, "", *("x" + "".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(2000))]:
        assert boilerplate.squeezed(line) == re.sub(r"\d+", "", "".join(line.split()).lower())
        if line:
            assert boilerplate.line_role(line, words) == boilerplate.line_role(line, {})
    assert words
