import random
import re

from ewpanel.llm.substring_dedup import substring_dedup


def cut(text):
    out, start = [], 0
    for i in range(1, len(text)):
        blank = lambda c: c in " \t\n\x0b\x0c\r"
        if not blank(text[i]) and (text[i - 1] == "\n" or (i > 1 and blank(text[i - 1]) and text[i - 2] in ".!?")):
            out.append(text[start:i])
            start = i
    return out + [text[start:]]


def plain(s):
    return re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", s.lower()).strip(" ")


def brute(rows, run, min_words):
    seen, gone = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        if rows[i][1] is None:
            continue
        s = cut(rows[i][1])
        size = min(run, len(s))
        for p in range(len(s) - size + 1):
            words = "\n".join(plain(x) for x in s[p : p + size])
            if sum(c in " \n" for c in words) < min_words - 1:
                continue
            if words in seen:
                gone.setdefault(i, set()).update(range(p, p + size))
            else:
                seen[words] = i
    out = []
    for i, (d, t) in enumerate(rows):
        out.append((str(d), None if t is None else "".join(x for p, x in enumerate(cut(t)) if p not in gone.get(i, ())), sorted(gone.get(i, ()))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=rng.randrange(1, 14))).capitalize() + rng.choice([". ", "! ", ".\n", "\n", ".  "]) for _ in range(60)]
    passage = "".join(pool[:6])
    rows = []
    for i in range(80):
        text = "".join(rng.choices(pool, k=rng.randrange(0, 12)))
        if i % 4 == 0:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + " " + passage + text[at:]
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "No end " * 20), (103, "No end " * 20)]
    for run, least in ((2, 12), (3, 5)):
        got = sorted(((str(r.doc_id), r.text, r.removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), run, least, whole=False).collect()), key=str)
        assert got == brute(rows, run, least)
        assert any(g[2] for g in got)


def test_odd_rows(spark, odd_docs):
    rows = substring_dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.doc_id, r.n_removed) for r in rows if r.doc_id != 6} == {(d, 0) for d in (1, 2, 3, 4, None, 5, 7, 8)}
    assert all(r.text == t for r in rows for t in [r.text] if r.n_removed == 0)
    assert substring_dedup(odd_docs.limit(0)).count() == 0
