"""The bounds before alignment, and which of two overlapping templates wins."""

import random

from eventloom.llm import licenses


def _where(words):
    where = {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    return where


def test_bounds_lose_no_match(monkeypatch):
    rng = random.Random(6)
    texts = {f"T{i}": " ".join(rng.choice("the of a in to be it on".split() + [f"w{i}{k}" for k in range(9)])
                               for _ in range(rng.randrange(12, 40))) for i in range(6)}
    templates = licenses._templates(texts, 0.8)
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            t = rng.choice(templates)
            words += rng.choices([w for x in templates for w in x.words], k=rng.randrange(25))
            words += [w for w in t.words if rng.random() > 0.15]
        with monkeypatch.context() as m:
            m.setattr(licenses, "_may_match", lambda words, t: len(words) >= t.needed)
            want = licenses.matches(words, templates, _where(words))
        assert licenses.matches(words, templates, _where(words)) == want


def test_the_whole_template_wins_over_a_part_of_it():
    short = " ".join(f"word{i}" for i in range(30))
    texts = {"A-short": short, "B-long": short + " " + " ".join(f"more{i}" for i in range(12))}
    templates = licenses._templates(texts, 0.8)
    for wanted, t in zip(texts, templates, strict=True):
        words = t.words[:7] + t.words[8:]
        found = licenses.matches(words, templates, _where(words))
        assert [m[0] for m in found] == [wanted]
