"""The pipeline, stage by stage, against a brute-force version of each stage on that stage's own input."""

import itertools
import random
import re

import pytest

import corpus_pipeline
from ledgerline.llm import line_dedup, toxicity
from ledgerline.llm.common import saved, table

from .test_operators import WORDS, items_in

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, r1 int"
TOXIC = ("vilest", "grumpish", "zorkling")


def write(spark, folder, docs, labels, bench):
    for name, rows, schema in (("documents", docs, COLUMNS), ("labels", labels, "doc_id long, toxic int"), ("benchmark", bench, "item_id long, text string, lang string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def corpus():
    """Documents, labels and benchmark items: toxic texts, repeated and near lines, near copies in other lines, benchmark passages, odd texts."""
    rng = random.Random(17)
    say = lambda n: [rng.choice(WORDS) + rng.choice("aeiou") + rng.choice(WORDS) for _ in range(n)]
    items = {i: say(n) for i, n in enumerate((6, 9, 16, 20, 28, 40))}
    texts, toxic = [], []
    for k in range(420):
        lines = [say(rng.randint(1, 14)) for _ in range(rng.randint(1, 3))] + [say(rng.choice((30, 150)))]
        kind = k % 7
        if kind in (1, 2):
            for w in rng.sample(TOXIC, 2):
                lines[-1].insert(rng.randrange(len(lines[-1])), w)
        elif kind == 3 and texts:  # lines of another document, as they are or with a word changed
            lines += [x.split(" ") for x in (texts[rng.randrange(len(texts))] or "").split("\n")]
            w = lines[rng.randrange(len(lines))]
            w[rng.randrange(len(w))] = "zz"
        elif kind == 4 and texts:  # words of another document in other lines, some of them changed
            w = re.split(r"\s+", rng.choice(texts))
            for _ in range(rng.choice((0, 2, 3, 12))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            at = len(w) // 2
            lines = [w[:at], w[at:]]
        elif kind == 5:
            part = list(rng.choice(list(items.values())))
            for i in rng.sample(range(len(part)), min(len(part), rng.choice((0, 0, 2, 3, 6)))):
                part[i] = "zz"
            lines[-1][10:10] = part
        texts.append("\n".join(" ".join(x) for x in lines))
        toxic.append(int(any(w in texts[-1].split() for w in TOXIC)))
    odd = [None, "", " \n", "Les.", "Les.", "one", texts[0], texts[0] + "\nLes.", "日本語 🙂\n\t", " ".join(say(12_000)), "y" * 20_000]
    docs = [(i, t, "en", "s", 0, "x", 1) for i, t in enumerate([*texts, *odd])] + [(None, "lone text of a row without id", None, None, None, None, None)]
    labels = [(i, x) for i, x in enumerate(toxic)] + [(None, 1), (3, None)]
    bench = [(i, " ".join(v).upper() + ".", "en") for i, v in items.items()] + [(90, None, None), (91, "", "en")]
    return docs, labels, bench, items, toxic


def one_edit(a, b):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) <= 1


def lines_left(rows):
    """Texts by id after the line stage; ids of emptied rows are left out."""
    lines = sorted(((-1 if i is None else i), k, tuple(re.findall(r"[^ \t\r\v\f]+", x))) for i, t in rows.items() for k, x in enumerate((t or "").split("\n")))
    gone, seen = set(), []
    for i, k, w in (x for x in lines if x[2]):
        near = lambda v: min(len(w), len(v)) >= line_dedup.NEAR_WORDS and abs(len(w) - len(v)) <= 1 and one_edit(w, v)  # noqa: E731, B023
        if any(w == v or near(v) for v in seen):
            gone.add((i, k))
        seen.append(w)
    out = {}
    for i, t in rows.items():
        left = [(k, x) for k, x in enumerate((t or "").split("\n")) if ((-1 if i is None else i), k) not in gone]
        if len(left) == len((t or "").split("\n")):
            out[i] = t
        elif any(x.strip() for _, x in left):
            out[i] = "\n".join(x for _, x in left)
    return out


def one_of_each(rows, size=5):
    """Ids that the near-duplicate stage keeps: the least of each component, and rows without id."""
    sets = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    low = {i: i for i in rows if i is not None}
    for a, b in itertools.combinations(sorted(low), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and low[a] != low[b]:
            x, y = sorted((low[a], low[b]))
            low = {i: x if c == y else c for i, c in low.items()}
    return {i for i in rows if i is None or low[i] == i}


def test_each_stage_by_brute_force(spark, tmp_path):
    import public_tokenizers
    import sentencepiece as library

    docs, labels, bench, items, toxic = corpus()
    folder = write(spark, tmp_path, docs, labels, bench)
    frames, before = [table(spark, folder, "documents")], {r[0]: r[1] for r in docs}
    for name, stage in corpus_pipeline.STAGES:
        frames.append(saved(stage(spark, frames[-1], folder), f"test-{name}"))
        assert name == "sentencepiece" or frames[-1].columns == frames[0].columns
    got = [{r.doc_id: r for r in f.collect()} for f in frames]
    assert all(len(x) == f.count() for x, f in zip(got, frames, strict=True))
    texts = [{i: r.text for i, r in x.items()} for x in got]

    model = toxicity.fit(frames[0], table(spark, folder, "labels"))
    assert texts[1] == {i: t for i, t in before.items() if model.score(model.features([t or ""]))[0] < 0.5}
    caught = [i not in texts[1] for i, x in enumerate(toxic) if x]
    spared = [i in texts[1] for i, x in enumerate(toxic) if not x]
    assert sum(caught) >= 0.95 * len(caught) and sum(spared) >= 0.97 * len(spared)

    assert texts[2] == lines_left(texts[1]) and texts[2] != texts[1]
    assert all(r.n_chars == len(r.text or "") for r in got[2].values())

    kept = one_of_each(texts[2])
    assert texts[3] == {i: t for i, t in texts[2].items() if i in kept} and 3 < len(texts[2]) - len(kept) < 100

    clean = {i: t for i, t in texts[3].items() if not items_in(t, items)}
    assert texts[4] == clean and 20 < len(texts[3]) - len(clean) < 60

    lib = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert texts[5] == texts[4]
    for r in got[5].values():
        assert list(r.ids) == lib.encode(r.text or "") and r.n_tokens == len(r.ids)

    assert sorted(corpus_pipeline.run(spark, folder).collect(), key=repr) == sorted(got[5].values(), key=repr)


@pytest.mark.parametrize("rows", [[], [(0, None, None, None, None, None, None), (1, "", "en", "s", 0, "x", 1), (2, " ", None, "s", 1, None, None)]])
def test_pipeline_of_empty_tables_and_texts(spark, tmp_path, rows):
    out = corpus_pipeline.run(spark, write(spark, tmp_path, rows, [], []))
    assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")] + ["ids", "n_tokens"]
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(r[0], r[1]) for r in rows]
