import math
import random
import re
import textwrap

from verdara.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_matches(text, templates, threshold):
    blocks = (text or "").split("\n")
    if re.search(r"\n[ \t\r]*\n", text or ""):
        blocks = blocks + [p for p in re.split(r"\n[\x20\t\r]*\n[\x20\t\n\f\r]*", text) if "\n" in p]
    lines = [ws for ws in map(split, (text or "").split("\n")) if ws]
    out = {}
    for i, first in enumerate(lines):
        for label, t in templates:
            ws, own, after = set(split(t)), set(first), 0
            if not ws & own:
                continue
            for line in lines[i + 1:]:
                if after >= len(split(t)):
                    break
                own |= set(line)
                after += len(line)
            hit = len(ws & own)
            if hit >= math.ceil(threshold * len(ws) - 1e-9):
                out.setdefault(("run", i), []).append((hit / len(ws), len(ws), label))
    for b, block in enumerate(blocks):
        own = set(split(block))
        for label, t in templates:
            ws = set(split(t))
            hit = len(ws & own)
            if hit >= math.ceil(threshold * len(ws) - 1e-9):
                out.setdefault(b, []).append((hit / len(ws), len(ws), label))
    return [max(v) for v in out.values()]


def brute(text):
    ws = split(text)
    at = [(i, k) for k, p in L.BASE.items() for i in range(len(ws)) if ws[i:i + len(p)] == p]
    best = brute_matches(text, L.TEMPLATES, 0.8)
    base = sorted({k for _, k in at})
    return (len(ws), len(at), min([i for i, _ in at], default=None), max([i for i, _ in at], default=None),
            ",".join(base), ",".join(sorted({*base, *(b[2] for b in best)})),
            1.0 if at else max([b[0] for b in best], default=0.0))


def texts():
    r = random.Random(4)
    notices = [t for _, t in L.TEMPLATES]
    yield from ["MIT license mit LICENSE apache license general public license", "Licensed under CC BY 4.0",
                "Licensed under CC BY-NC 4.0.", "license", "the Mit\nLicense", "mit-license é license"]
    for _ in range(300):
        ws = r.choice(notices).split()
        for _ in range(r.randint(0, 3)):
            ws[r.randrange(len(ws))] = r.choice(["word", "the", "license", ""])
        if r.random() < 0.5:
            r.shuffle(ws)
        sep = r.choice([" ", " ", "\n", "\n\n", "\n# "])
        yield "\n".join([r.choice(["intro text", "a\n", "1.0"]), sep.join(ws), r.choice(["", "end of it"])])


def test_matches_brute_force(spark):
    every = list(texts())
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in L.RESULTS) for r in L.scan(docs).collect()}
    for i, t in enumerate(every):
        assert got[i] == brute(t), repr(t)


def test_wrapped_and_commented_notices(spark):
    grant = dict(L.TEMPLATES[1:2])["mit"]
    wrapped = textwrap.wrap("Some words before it. " + grant, 40)
    many = ["filler line of words"] * (3 * L.CHUNK) + wrapped + ["more"] * 200
    every = ["\n".join(wrapped), "\n".join("# " + x for x in wrapped), "\n\n".join(wrapped), "\n".join(many),
             "\n".join(["\n".join(grant.split()[:10]), *["other words"] * 100, *grant.split()[10:20]])]
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in L.scan(docs).collect()}
    assert got == {0: ("mit", 1.0), 1: ("mit", 1.0), 2: ("mit", 1.0), 3: ("mit", 1.0), 4: ("", 0.0)}


def test_random_sets_lose_no_match(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    templates = [(f"t{i}", " ".join(r.sample(words, r.randint(1, 12)))) for i in range(15)]
    every = [" ".join(r.sample(words, r.randint(0, 25))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(every)), "_id long, _text string")
    for threshold in (0.5, 0.8, 1.0):
        got = {(x["_id"], x["template"]) for x in L.matches(rows, templates, threshold).collect()}
        want = {(i, k) for i, t in enumerate(every) for k, (_, ws) in enumerate(templates)
                if len(set(t.split()) & set(ws.split())) >= math.ceil(threshold * len(set(ws.split())) - 1e-9)}
        assert got == want


def test_edge_cases(edge_docs, no_docs, edge_rows):
    rows = L.scan(edge_docs).collect()
    want = sorted([(k, *brute(t)) for k, t, _ in edge_rows], key=str)
    assert sorted([(r["doc_id"], *(r[c] for c in L.RESULTS)) for r in rows], key=str) == want
    assert L.scan(no_docs).collect() == []
