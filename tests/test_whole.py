"""Queries of the catalog over whole tables, against plain loops on small fixtures."""

import random
import re

import __spark_entry__ as entry


def run(spark, tmp_path, query, **tables):
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    return entry.queries()[query](spark, str(tmp_path)).collect()


DOCS = "doc_id long, text string, n_chars long"
ORDERS = "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string"


def test_statements_of_all_customers(spark, tmp_path):
    orders = [(k, k % 23 + 1, 100.25 + k, "OFP"[k % 3]) for k in range(1, 70)]
    got = {(r.doc_id, r.row, r.col, r.cell) for r in run(spark, tmp_path, "md_table_cells", orders=(orders, ORDERS))}
    want = {(c, 0, i, h) for c in range(1, 24) for i, h in enumerate(("Order", "Amount", "Status"))}
    for c in range(1, 24):
        for n, (k, _, price, status) in enumerate(o for o in orders if o[1] == c):
            said = f"{price:.2f}"
            want |= {(c, n + 1, 0, str(k)), (c, n + 1, 1, f"{said} {said}" if k % 5 == 0 else said), (c, n + 1, 2, status)}
    assert got == want


def test_doubled_glyphs_of_whole_texts(spark, tmp_path):
    texts = ["some AAmmoouunntt here", "plain book", "at last 11223344", None, "aaaa zz", "", "x\n**NNeett** iinn", "again"]
    got = {(r.doc_id, r.pos, r.word, r.painted_once) for r in run(spark, tmp_path, "doubled_glyphs", documents=([(i, t, 0) for i, t in enumerate(texts)], DOCS))}
    want = set()
    for i, t in enumerate(texts):
        for n, w in enumerate((("TToottaall " if i % 7 == 0 else "") + t).split() if t is not None else []):
            w = re.sub(r"[*_`|#]", "", w)
            if len(w) >= 4 and w[::2] == w[1::2] and len(set(w)) > 1:
                want.add((i, n, w, w[::2]))
    assert got == want and len(want) == 6


def test_doubled_words_of_all_lengths(spark, tmp_path):
    r = random.Random(7)
    texts = [None, "", "total total a a 5 5 *5*", "net sales net sales net sales", "of of of of"]
    for n in [1, 2, 3, 31, 63, 64, 65, 66]:
        run_ = [f"w{r.randrange(500)}" for _ in range(n)]
        texts.append(" ".join(["lead", *run_, *run_, "tail"]))
    texts += [" ".join(r.choice("ab cd 12".split()) for _ in range(r.randrange(1, 200))) for _ in range(30)]
    want = set()
    for i, t in enumerate(texts):
        own, at = [w for w in (re.sub(r"[*_`|#]", "", x) for x in (t or "").split()) if w], 0
        while at < len(own):
            n = next((n for n in range(64, 0, -1) if len(own) >= at + 2 * n and own[at : at + n] == own[at + n : at + 2 * n] and (n > 1 or len(own[at]) >= 4 or re.search("[0-9]", own[at]))), 0)
            if n:
                want.add((i, at, " ".join(own[at : at + n])))
            at += max(1, 2 * n)
    assert {(x.doc_id, x.pos, x.run) for x in run(spark, tmp_path, "doubled_words", documents=([(i, t, 0) for i, t in enumerate(texts)], DOCS))} == want
    assert {1, 2, 3, 31, 63, 64} <= {len(x[2].split()) for x in want}


def test_batch_contract_asks_for_all(spark, tmp_path):
    ids = [*range(0, 2500), 2998, 3001, 10**12 + 7]
    rows = run(spark, tmp_path, "batch_contract", documents=([(i, "", i % 50) for i in ids], DOCS))
    assert sorted((r.doc_id, r.n_chars) for r in rows if r.error is None) == [(i, i % 50) for i in ids]
    blocks = {i // 1000 for i in ids}
    assert {(r.request, r.doc_id, r.n_chars) for r in rows if r.error == "not found"} == {(b, -1 - b, None) for b in blocks}
    for b in blocks:
        mine = sorted((r.pos, r.doc_id) for r in rows if r.request == b)
        assert [p for p, _ in mine] == list(range(len(mine))) and len(mine) <= 1001


def test_split_words_of_whole_texts(spark, tmp_path):
    texts = ["a re-cov ery of re- covery", "plain", "re-cov|ery", None, "", "has re-covery", "long " * 3000 + "re-c overy"]
    got = {(r.doc_id, r.word, r.splits, r.definite) for r in run(spark, tmp_path, "split_words", documents=([(i, t, 0) for i, t in enumerate(texts)], DOCS))}
    # Of the text: (splits, definite); of the form put before it, by doc_id modulo 5.
    own, put = {0: (2, 1), 2: (1, 1), 6: (1, 1)}, {1: (1, 1), 2: (1, 0), 3: (1, 1)}
    both = {i: (own.get(i, (0, 0)), put.get(i % 5, (0, 0))) for i in range(len(texts))}
    assert got == {(i, "re-covery", a[0] + b[0], a[1] + b[1]) for i, (a, b) in both.items() if a[0] + b[0]}


def test_headers_of_over_5000_pages(spark, tmp_path):
    """A source's header is one row of all its pages, as its SQL has it, also where there are more than its first pages' total."""
    docs = [(i, f"text {'abcdefghijk'[i % 11]}" * 3, "wide" if i % 7 else "narrow") for i in range(7600)]
    got = run(spark, tmp_path, "running_header_masked", documents=(docs, "doc_id long, text string, source string"))
    n = {s: sum(d[2] == s for d in docs) for s in ("wide", "narrow")}
    assert n["wide"] > 6000
    want = {(s, f"Report of {s} page # of #", k, 1, f"Report of {s} page 1 of 5000") for s, k in n.items()}
    assert {tuple(r) for r in got} == want | {(s, "Printed at #:#:# on sheet #", k, 1, "Printed at 10:32:07 on sheet 1") for s, k in n.items()}
