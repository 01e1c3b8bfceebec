import random

import numpy as np

from loomtrace.llm.examples import EXAMPLES
from loomtrace.llm.quality import CLASSES, STATS, classify, features, fit, learn_common, not_prose, with_statistics
from loomtrace.llm.text_stats import free_words, statistics
from loomtrace.llm.tokens import encoder, with_tokens


def stats_of(text, common=frozenset()):
    return dict(zip(STATS, statistics([text], common)[0]))


def test_statistics():
    t = "The mill is in the town.\n\n- one\n| 12 | 3 |\n"
    s = stats_of(t, {"the", "is", "in"})
    assert s["n_words"] == 7 and s["punct_lines"] == 1 / 3 and s["list_lines"] == 1 / 3
    assert abs(s["ended_share"] - 25 / len(t)) < 1e-9 and s["flow_share"] == s["ended_share"]
    assert s["digit_ratio"] == 3 / len(t) and s["symbol_ratio"] == 3 / len(t) and abs(s["common_share"] - 4 / 7) < 1e-9
    assert abs(s["name_share"] - 1 / 7) < 1e-9 and abs(s["distinct_ratio"] - 6 / 7) < 1e-9 and s["mean_word"] == 21 / 7
    x = statistics([None, "", " \n\t", "a", None, "\n"], set())
    assert (x[[0, 1, 2, 4, 5]] == 0).all() and x[3][0] == 1
    long = stats_of("The mill is in the town. " * 100_000, {"the", "is"})
    assert long["n_words"] == 600_000 and long["ended_share"] == 1.0
    assert stats_of("x" * 3_000_000)["n_words"] == 1
    assert stats_of("no no no no")["repeat_ratio"] == 0.75 and stats_of("aB3c")["switch_ratio"] == 0.75
    assert stats_of("12. one\n1899 – two\n3 houses stood there.")["list_lines"] == 2 / 3
    assert stats_of("It was so.<ref>A, p. 3</ref>\nHe said \"no.\"\nA [[link]]")["punct_lines"] == 2 / 3
    # scripts without blanks are parted where the script changes; lone surrogates and the far planes do no harm
    assert list(free_words(["この町は", "a{b} c\U0001f600 d", "\ud800x"])) == [{"この", "町", "は"}, {"c", "d"}, {"x"}]


def test_batches_do_not_matter():
    texts = [t for _, _, t in EXAMPLES]
    common = {"the", "of", "de", "の"}
    one = statistics(texts, common)
    assert np.allclose(one, np.vstack([statistics([t], common) for t in texts]))


def test_common_words(spark):
    rows = [("en", f"the mill of {chr(97 + i % 26) * 3} {chr(97 + i // 26) * 4}") for i in range(60)] + [("fr", f"le moulin {'abcdef'[i % 6] * 5}") for i in range(20)]
    rows += [(None, "the table"), ("x", "rare word"), ("x", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = learn_common(df, "text", "lang")
    assert {"the", "mill", "of", "le", "moulin"} <= got and not {"rare", "word", "zzz"} & got
    assert learn_common(df, "text") >= {"the", "le"} and learn_common(df.limit(0), "text") == frozenset()


def corpus(spark, copies=15):
    rows = []
    for c in range(copies):
        for i, (_, kind, text) in enumerate(EXAMPLES):
            rows.append((c * 100 + i, (text + "\n") * (1 + c % 3) if text else text, kind, 0.5))
    rows += [(9000, None, "junk", 0.5), (9001, "", "junk", 0.5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kind string, n_words double"), {r[0]: r[2] for r in rows}


def mixture(df, steps):
    common = learn_common(df, "text")
    stats = with_statistics(df, "text", common)
    return stats, common, fit(stats, common, steps)


def test_mixture(spark):
    df, kinds = corpus(spark)
    stats, common, g = mixture(df, 8)
    assert set(g.classes) <= set(CLASSES) and abs(g.weight.sum() - 1) < 1e-9
    got = classify(stats, g)
    rows = got.collect()
    assert len(rows) == len(kinds)
    right = sum(r.kind == kinds[r.doc_id] for r in rows)
    assert right > 0.95 * len(rows)
    assert all(abs(sum(r[f"p_{c}"] for c in CLASSES) - 1) < 1e-6 for r in rows)
    found = {r.doc_id for r in not_prose(got).collect()}
    assert found == {r.doc_id for r in rows if r.kind != "prose"} and {9000, 9001} <= found
    # the same mixture whatever the partitions
    h = fit(stats.repartition(5), common, 8)
    assert np.allclose(g.mean, h.mean, atol=1e-6)


def test_step_is_em(spark):
    """One step on the cluster is the textbook step on all rows."""
    df, _ = corpus(spark, 2)
    stats, common, a = mixture(df, 1)
    b = fit(stats, common, 2)
    x = features(np.array([[r[s] for s in STATS] for r in stats.collect()]))
    z = (x - a.shift) / a.scale
    p = a.weight * np.exp(-0.5 * (((z[:, None] - a.mean) ** 2) / a.var).sum(axis=2)) / np.sqrt((2 * np.pi * a.var).prod(axis=1))
    r = p / p.sum(axis=1, keepdims=True)
    assert np.allclose(r, a.responsibilities(x), atol=1e-6)
    n = r.sum(axis=0)
    live = n > 1e-3
    assert np.allclose(b.mean[live], (r.T @ z)[live] / n[live, None], atol=1e-6)


# Sentences, rows and lines of no generator, in scripts the examples do not have.
PROSE = {
    "en": "Rain fell on the harbour all morning and the boats stayed where they were.|Nobody in the office could say why the letter had been sent back twice.|She counted the coins again, because the sum in the book was not the sum on the table.|By the time the train arrived, most of the passengers had gone home to sleep.|The committee will meet again in June, when the figures of the second quarter are known.|It is hard to tell from a photograph how steep the path really is.|Some of these trees are older than the wall that was built to protect them.|The cook said that the soup needed salt, and he was right about that.",
    "ru": "Дождь шёл всё утро, и лодки остались в гавани.|Никто в доме не знал, почему письмо вернулось обратно.|Она снова пересчитала деньги, потому что сумма в книге не сошлась.|Когда поезд пришёл, почти все пассажиры уже ушли домой.|Комитет соберётся в июне, когда станут известны новые цифры.|По снимку трудно понять, насколько крута эта тропа.|Эти деревья старше стены, которую построили вокруг них.",
    "el": "Η βροχή έπεφτε όλο το πρωί και οι βάρκες έμειναν στο λιμάνι.|Κανείς στο γραφείο δεν ήξερε γιατί το γράμμα γύρισε πίσω.|Μέτρησε πάλι τα χρήματα, γιατί το ποσό στο βιβλίο δεν ήταν σωστό.|Όταν έφτασε το τρένο, οι περισσότεροι είχαν πάει στο σπίτι.|Η επιτροπή θα συναντηθεί ξανά τον Ιούνιο, όταν θα είναι γνωστά τα νέα.|Αυτά τα δέντρα είναι πιο παλιά από τον τοίχο που τα προστατεύει.",
}


def outside(seed=3, each=40):
    r = random.Random(seed)
    prose = lambda s: "\n\n".join(" ".join(r.choice(s) for _ in range(r.randint(3, 7))) for _ in range(r.randint(1, 4)))
    word = lambda: "".join(r.choice(["ta", "ro", "mi", "nes", "kul", "ber", "os"]) for _ in range(r.randint(1, 4)))
    makers = [("prose", lambda lang=lang: (lang, prose(PROSE[lang].split("|")))) for lang in PROSE]
    makers += [
        ("list", lambda: ("en", "\n".join(f"- {word().title()} {word()}" for _ in range(r.randint(6, 30))))),
        ("list", lambda: ("en", "\n".join(f"{i + 1}. {word().title()}" for i in range(r.randint(6, 30))))),
        ("table", lambda: ("en", "\n".join(",".join([word(), *(str(r.randint(0, 9999)) for _ in range(5))]) for _ in range(r.randint(5, 20))))),
        ("table", lambda: (None, "\n".join("| " + " | ".join(f"{r.random():.3f}" for _ in range(6)) + " |" for _ in range(r.randint(5, 20))))),
        ("junk", lambda: ("en", "\n".join(f"if ({word()}[{r.randint(0, 9)}] == 0) {{ {word()}({word()}, &{word()}); }}" for _ in range(r.randint(3, 12))))),
        ("junk", lambda: (None, "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(r.randint(200, 600))))),
        ("junk", lambda: ("en", r.choice(["ha", "lol ", "!", "spam "]) * r.randint(40, 200))),
    ]
    return [(i * 100 + j, kind, *make()) for i, (kind, make) in enumerate(makers) for j in range(each)]


def test_texts_from_outside(spark):
    rows = outside()
    df = spark.createDataFrame([(i, lang, t) for i, _, lang, t in rows], "doc_id int, lang string, text string")
    common = learn_common(df, "text", "lang")
    stats = with_statistics(df.drop("lang"), "text", common)
    found = {r.doc_id for r in not_prose(classify(stats, fit(stats, common))).collect()}
    cases = {i for i, kind, *_ in rows if kind != "prose"}
    assert len(found & cases) >= 0.95 * len(cases)
    assert len(found & cases) >= 0.95 * len(found)


def test_empty(spark):
    df, _ = corpus(spark, 1)
    assert mixture(df.limit(0), 2)[2] is None
    same = df.limit(1).crossJoin(spark.range(5)).drop("id")
    stats, _, g = mixture(same, 2)
    assert classify(stats, g).count() == 5


def test_tokens(spark):
    texts = ["The mill is old.", "", None, "x" * 20_000, "<|endoftext|> 村", "a  b\n\n"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "i int, text string, n_tokens int")
    got = {r.i: r.n_tokens for r in with_tokens(df, "text").collect()}
    e = encoder()
    assert got == {i: len(e.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert e.decode(e.encode_ordinary(texts[4])) == texts[4]
