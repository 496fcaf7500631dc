"""Decontamination and quality figures against plain Python, and the pipeline's stages on an empty table."""

import collections
import random
import re

from tallgrass.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


def least_distance(item, text):
    """The least edit distance of ``item`` to any substring of ``text``."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(item, 1):
            last, row[i] = row[i], min(last + (p != c), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def edited(r, text, edits):
    for _ in range(edits):
        at = r.randrange(1, len(text) - 1)
        text = text[:at] + r.choice(["", "q", "q" + text[at]]) + text[at + 1 :]
    return text


def test_decontamination_matches_every_distance(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(40)]
    phrase = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(r.randint(5, 20))) for i in range(8)] + [(8, None), (9, "")]
    docs = [(100, None), (101, ""), (102, items[0][1]), (103, items[1][1].upper().replace(" ", ", ")), (104, " ".join(t for _, t in items[:8]))]
    for k in range(40):
        item = items[k % 8][1]
        docs.append((k, f"{phrase(6)} {edited(r, item, r.randint(0, decontaminate.budget(len(item)) + 2))} {phrase(6)}"))
    docs.append(docs[-1])
    data = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, text in docs:
        for i, item in items:
            item = decontaminate.normal(item)
            if len(item) >= decontaminate.LEAST_CHARS and (n := least_distance(item, decontaminate.normal(text))) <= decontaminate.budget(len(item)):
                want.append((d, i, n))
    got = sorted((x.doc_id, x.item_id, x.distance) for x in decontaminate.contaminated(data, bench).collect())
    assert got == sorted(want) and len({n for *_, n in want}) > 2
    bad = {d for d, *_ in want}
    assert sorted(x.doc_id for x in decontaminate.drop_contaminated(data, bench).collect()) == sorted(d for d, _ in docs if d not in bad)


def figures(text):
    words, lines, seen, dup = WORD.findall(text or ""), (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def test_quality_figures_match_plain_python(spark):
    r = random.Random(12)
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(100).collect()]
    rows += [(None, "a b\na b\n"), (900, None), (901, ""), (902, "\n\n \n\t\n"), (903, "é#ü\né#ü\n é#ü\né#ü"), (904, "a b c d e f g h " * 9), (905, "x\x0by\x1cz <|> $5%"), (905, "x\x0by\x1cz <|> $5%"), (906, "w" * 9000 + "\n" + "w" * 9000)]
    for i in range(60):
        rows.append((1000 + i, "".join(r.choice(["a", "b", "€", " ", " ", "\n", "#", "*", "a b a b a b a b\n"]) for _ in range(r.randint(0, 120)))))
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.judge(docs, labels).collect()
    assert sorted(str(tuple(x[n] for n in names)) for x in got) == sorted(str((d, *figures(t))) for d, t in rows)
    assert not any(x.kept and x.base_failed for x in got) and any(x.kept for x in got)


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where("false"), SF)
        assert out.count() == 0 and set(docs.columns) <= set(out.columns), name
