"""Operator 7's fusion against a plain computation of every term, on documents and on pages."""

import math
from collections import Counter, defaultdict

import pytest

from foliate.llm import language_id as L


def classes(text):
    data = " ".encode() + bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in (text or "").encode().lower()) + b" "
    return [((data[i - 1] << 16 | data[i] << 8 | data[i + 1]) * 2654435761 % 2**32) >> 16 for i in range(1, len(data) - 1) if data[i] != 32]


def trained(rows):
    counts = defaultdict(Counter)
    for text, label in rows:
        if label is not None:
            counts[label].update(classes(text))
    return {k: counts[k] for k in sorted(counts)}


def brute(model, rows):
    """(language, posterior, language by text) of rows (text, host, suffix, declared)."""
    names = [*model, "und"]
    total = {k: sum(c.values()) for k, c in model.items()}

    def by_text(codes):
        known = [sum(math.log((model[k][c] + 0.5) / (total[k] + 0.5 * 65536)) for c in codes) / 3 for k in model]
        return [*known, -math.log(65536) * len(codes) / 3]

    scores = [by_text(classes(r[0])) if classes(r[0]) else None for r in rows]
    best = lambda v: max(range(len(v)), key=lambda i: (v[i], -i))
    seen = [(r[1], r[2], r[3], best(s)) for r, s in zip(rows, scores) if s is not None]
    n = len(names)
    all_k = Counter(k for *_, k in seen)
    overall = [(all_k[k] + 1) / (len(seen) + n) for k in range(n)]
    given = sum(d is not None for _, _, d, _ in seen)
    out = []
    for (text, host, suffix, declared), s in zip(rows, scores):
        if s is None:
            out.append(("und", 1.0, "und"))
            continue
        at_suffix = Counter(k for _, x, _, k in seen if x == suffix)
        at_host = Counter(k for h, x, _, k in seen if (h, x) == (host, suffix))
        with_it = Counter(k for _, _, d, k in seen if d == declared)
        fused = []
        for k in range(n):
            above = (at_suffix[k] + 20 * overall[k]) / (sum(at_suffix.values()) + 20)
            v = s[k] + math.log((at_host[k] + 20 * above) / (sum(at_host.values()) + 20))
            if declared is not None:
                share = sum(with_it.values()) / given
                v += math.log((with_it[k] + 20 * share) / (all_k[k] + 20))
            fused.append(v)
        top = max(fused)
        out.append((names[best(fused)], 1 / sum(math.exp(v - top) for v in fused), names[best(s)]))
    return out


WORDS = {"en": "the of and to thing shing", "de": "der und die nicht schön", "fr": "le de être où les", "xx": "qza qzo qzi"}


def texts():
    out = []
    for i in range(120):
        lang = [*WORDS][i % 4 if i % 7 else 0]
        words = WORDS[lang].split()
        text = " ".join(words[(i * j) % len(words)] for j in range(1, 2 + i % 9))
        out.append((i % 110, None if i == 50 else "" if i == 51 else "12 !" if i == 52 else text, None if i % 5 == 0 else lang, f"h{i % 6}" if i % 11 else None))
    return out + [(3, texts_shared, "en", "h1")] * 5


texts_shared = "of the"


def test_documents(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id bigint, text string, lang string, source string, _lid_host string").repartition(3)
    out, names = L.document_languages(docs)
    got = sorted((repr((r.doc_id, r.text, r.lang, r.source)), r[names["language"]], r[names["text_language"]], r[names["posterior"]], r[names["kept"]]) for r in out.collect())
    # equal rows count once in the sample
    model = trained([(t, g) for _, t, g in {r[:3] for r in rows}])
    want = brute(model, [(r[1], r[3], None, r[2]) for r in rows])
    want = sorted((repr(r), w[0], w[2], w[1], w[0] != "und") for r, w in zip(rows, want))
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[4] == w[4]
        assert g[3] == pytest.approx(w[3], rel=1e-4)
    assert len({g[1] for g in got}) == 5


def test_pages(spark):
    pages, plain = [], []
    for i, (_, text, _, _) in enumerate(texts()):
        declared = [None, "en", "de", "fr"][i % 4]
        host = [None, "a.de", "b.fr", "c.de", "d.com"][i % 5]
        tag = "<html>" if declared is None else f'<HTML class="x" lang="{declared.upper()}-X">'
        html = None if i == 9 else f"{tag}<script>var the = of;</script><!-- the --><p>{text or ''}</p></html>"
        pages.append((i, None if host is None else f"https://{host.upper()}:80/x", html))
        shown = None if html is None else f"  {text or ''} "
        plain.append((shown, host, host and host.split(".")[-1], None if html is None else declared))
    model = L.trained(spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([(w, k) for k, w in WORDS.items()])], "doc_id bigint, text string, lang string"))
    got = sorted(L.page_languages(spark.createDataFrame(pages, "page_id bigint, url string, html string"), model).collect())
    want = brute(trained([(w, k) for k, w in WORDS.items()]), plain)
    for g, w in zip(got, want):
        assert (g.language, g.text_language, g.kept) == (w[0], w[2], w[0] != "und")
        assert g.posterior == pytest.approx(w[1], rel=1e-4)
