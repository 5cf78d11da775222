"""Licence scan, decontamination, line and passage removal against brute force."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, license_scan, line_dedup, substring_dedup
from tests.llm.helpers import edge_docs, no_docs, words


def brute_license(text):
    w = words(text)
    base = [(i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    own = []
    for t in license_scan.TEMPLATES:
        for at in range(-len(t.words), len(w)):
            def stands(k, t=t, at=at):
                return 0 <= at + k < len(w) and w[at + k] == t.words[k]
            share = sum(map(stands, range(len(t.words)))) / len(t.words)
            if share >= license_scan.COVERAGE and all(map(stands, t.required)):
                own.append((t.label, share))
    places = [i for i, _ in base]
    return (len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})),
            ",".join(sorted({x for _, x in base} | {x for x, _ in own})), max((s for _, s in own), default=0.0))


def test_license_report(spark):
    docs = edge_docs(spark)
    extra = ["Licensed under the Apache License, Version 2.0. x CC-BY. And again: the apache license",
             "GNU General Public License, version 3", "THE MIT LICENSE MIT license", "apache\nlicense version 2.0",
             "Permission is hereby granted, free of charge, to anyone obtaining a copy of this software",
             "released under the mit license all rights reserved", "mit  license", "École MIT LICENSÉ"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    got = license_scan.report(license_scan.scan(docs)).collect()
    want = [(r["doc_id"], *brute_license(r["text"])) for r in docs.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_license_files_with_clashing_columns_and_no_rows(spark):
    assert license_scan.scan(edge_docs(spark).withColumn("w", F.lit(1)).withColumn("known", F.lit(2))).count() == edge_docs(spark).count()
    assert license_scan.report(license_scan.scan(no_docs(spark))).count() == 0


def brute_hits(text, items, n=10):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        q = words(t)
        for at in range(max(1, len(q) - n + 1) if q else 0):
            win = q[at:at + n]
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 300)
    docs = edge_docs(spark)
    rows = docs.collect()
    text = next(r["text"] for r in rows if r["text"] and 300 < len(r["text"]) < 2000)
    w = text.split()
    items = [(9, " ".join(w[5:30])), (10, " ".join(w[20:24]).upper()), (11, "one"), (12, None), (13, "..."), (14, "absent words here"),
             (10, "one two"), (9, " ".join(w[5:30])), (None, "one"), (15, " ".join(w[40:52]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.contamination(decontaminate.find_matches(docs, bench, block_bytes=block_bytes)).collect()
    real = [x for x in items if x[0] is not None]
    want = [(r["doc_id"], *brute_hits(r["text"], real)) for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.find_matches(no_docs(spark), bench).count() == 0
    got = decontaminate.contamination(decontaminate.find_matches(edge_docs(spark), bench.where("item_id < 0")))
    assert got.where("contaminated").count() == 0 and got.count() == edge_docs(spark).count()


def test_proximity_matches_tolerate_changed_words(spark):
    item = "the quick brown fox jumps over the lazy sleeping dog"
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "x the quick brown fox then jumps over that lazy sleeping dog the the y"),
                                  (3, "dog the over fox brown lazy jumps quick sleeping " * 2)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_matches(
        docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got[1]["items"] == ["5"] and (got[1]["starts"], got[1]["ends"]) == ([1], [11])
    assert got[2]["items"] == [] and got[2]["near_items"] == ["5"]


def brute_near(text, items, n=10, slop=3, share=0.8):
    w, ids = words(text), set()
    for item, t in items:
        q = words(t)
        for at in range(max(1, len(q) - n + 1) if q else 0):
            win = q[at:at + n]
            for base in range(-len(win) - slop, len(w) + slop):
                places = [w[max(0, base + k - slop):max(0, base + k + slop + 1)] for k in range(len(win))]
                if sum(x in p for x, p in zip(win, places, strict=True)) >= share * len(win):
                    ids.add(str(item))
                    break
    return sorted(ids)


@pytest.mark.parametrize("segment_words", [1, 60, 400_000])
def test_proximity_matches_against_brute_force(spark, monkeypatch, segment_words):
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", segment_words)
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=k))) for i, k in enumerate([10, 10, 14, 12, 10, 11, 5, 3, 2, 2])]
    texts = [None, "", "w1"]
    for _, t in items * 6:
        q = t.split()
        for _ in range(rnd.randrange(4)):
            what, at = rnd.choice("rdis"), rnd.randrange(len(q))
            if what == "r":
                q[at] = f"absent{rnd.randrange(10**6)}"
            elif what == "d":
                del q[at:at + 1]
            elif what == "i":
                q.insert(at, rnd.choice(vocabulary))
            else:
                q[at:at + 2] = q[at:at + 2][::-1]
            q = q or ["w2"]
        before, after = (rnd.choices(vocabulary, k=rnd.choice([0, 0, 2, 20])) for _ in range(2))
        texts.append(" ".join([*before, *q, *after]))
    # the window's first words end one document, its last ones begin the next
    texts += [" ".join(items[0][1].split()[:5]), " ".join(items[0][1].split()[5:])]
    # one word replaced by a word that no document or item has; it is the rarest
    texts.append(" ".join(["unseen", *items[4][1].split()[1:]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["near_items"] for r in decontaminate.find_matches(docs, bench).collect()}
    assert got == {i: brute_near(t, items) for i, t in enumerate(texts)}
    assert "4" in got[len(texts) - 1]


def brute_lines(rows, ratio, least):
    """rows of (host, text) -> (n_lines, n_dropped, text)."""
    def split(t):
        return (t or "").split("\n")

    total, pages = {}, {}
    for host, text in rows:
        total[host] = total.get(host, 0) + 1
        for x in {x.strip(" ") for x in split(text)} - {""}:
            pages[host, x] = pages.get((host, x), 0) + 1
    bad = {k for k, n in pages.items() if n >= least and n / total[k[0]] > ratio}
    out = []
    for host, text in rows:
        kept = [x for x in split(text) if (host, x.strip(" ")) not in bad]
        gone = len(split(text)) - len(kept)
        out.append((sum(x.strip(" ") != "" for x in split(text)), gone, "\n".join(kept) if gone else text))
    return out


def test_boilerplate_lines_by_host(spark):
    rows = [("a", f"menu\nstory {i}\n\n footer " + ("\nsometimes" if i < 3 else "")) for i in range(20)]
    rows += [("b", "menu\nother"), ("b", "text"), (None, "menu\nx")] + [(None, "menu")] * 6 + [("a", None), ("a", ""), ("a", "menu")]
    rows += [("a", "line\n" * 3000 + "menu")]
    df = spark.createDataFrame([(h, t, 1, "x") for h, t in rows], "host string, text string, _drop long, line string").repartition(3)
    got = line_dedup.drop_lines(df, F.col("host"), ratio=0.3, min_pages=5, n_lines="n", n_dropped="d", by_text=False)
    assert got.columns == ["host", "text", "_drop", "line", "n", "d"] or set(got.columns) == {"host", "text", "_drop", "line", "n", "d"}
    want = [(h, t, n, d) for (h, _), (n, d, t) in zip(rows, brute_lines(rows, 0.3, 5), strict=True)]
    assert sorted(map(str, [(r["host"], r["text"], r["n"], r["d"]) for r in got.collect()])) == sorted(map(str, want))
    assert line_dedup.drop_lines(df.where("1 = 0"), F.col("host")).count() == 0


def test_the_share_of_distinct_texts_decides(spark):
    """Defaults: over half of a host's distinct texts, copies once; a single text tells nothing."""
    rows = [("a", "menu\nunique one\nhalf"), ("a", "menu\nunique two\nhalf"), ("a", "menu\nunique three"), ("a", "other\nunique four"),
            ("b", "copied\nline"), ("b", "copied\nline"), ("b", "copied\nline"), ("c", "shared\nx"), ("c", "shared\ny"),
            ("d", "twice\nbody")] + [("d", f"text {i}") for i in range(3)] + [("d", "twice\nbody")] * 20
    df = spark.createDataFrame(rows, "host string, text string").repartition(3)
    got = line_dedup.drop_lines(df, F.col("host"), n_dropped="d").collect()
    gone = {(r["host"], r["text"], r["d"]) for r in got if r["d"]}
    assert gone == {("a", "unique one\nhalf", 1), ("a", "unique two\nhalf", 1), ("a", "unique three", 1), ("c", "x", 1), ("c", "y", 1)}
    assert len(got) == len(rows)


def test_page_text_and_host(spark):
    df = spark.createDataFrame([("http://A.example.com:80/x?y", "<html><head><style>p{}</style></head><p>One <b>two</b></p><br/>three<!-- no --></html>"),
                                (None, None), ("nothing", "")], "url string, html string")
    got = df.select(line_dedup.host_of(F.col("url")), line_dedup.page_text(F.col("html"))).collect()
    assert [tuple(r) for r in got] == [("a.example.com:80", "One two\nthree"), (None, None), ("", "")]


def brute_repeats(rows, min_words=25, least=4):
    def units(text):
        """(start, stop) of lines, cut after sentences of enough blank-separated words."""
        at = 0
        for line in text.splitlines(keepends=True) if "\n" in text else [text]:
            start = stop = at
            pieces = line[:-1].split(" ") if line.endswith("\n") else line.split(" ")
            count = 0
            for k, piece in enumerate(pieces):
                stop += len(piece) + 1
                count += 1
                if count >= least and piece[-1:] in tuple(".!?") and (k < len(pieces) - 1 or line.endswith("\n")):
                    yield start, stop
                    start, count = stop, 0
            if start < at + len(line):
                yield start, at + len(line)
            at += len(line)

    seen, marks = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        n = 0
        for a, b in units(rows[k][1] or ""):
            w = tuple(words(rows[k][1][a:b]))
            if w:
                if w in seen:
                    marks.append((k, n, a, b, len(w)))
                seen.setdefault(w, k)
                n += 1
    out = []
    for k, n, a, b, size in marks:
        if out and out[-1][0] == k and out[-1][1] == n - 1:
            out[-1][1:] = [n, out[-1][2], b, out[-1][4] + size]
        else:
            out.append([k, n, a, b, size])
    return sorted((str(rows[k][0]), a, b, s) for k, _, a, b, s in out if s >= min_words)


def test_repeated_passages(spark):
    docs = edge_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = substring_dedup.repeats(docs).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["stop"], r["n_words"]) for r in got) == brute_repeats(rows)
    assert substring_dedup.repeats(no_docs(spark)).count() == 0


def test_removed_passages_are_cut_out_and_offsets_kept(spark):
    passage = ("Here begins a passage of many words. It goes on with a second sentence of words! "
               "A third one follows it, as thirds do? And then it ends with these last few words.")
    docs = spark.createDataFrame([(2, f"Own start here today. {passage} Own end."), (1, passage), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove(docs).collect()}
    start, stop = got[2]["removed"][0]
    whole = f"Own start here today. {passage} Own end."
    assert got[2]["text"] == whole[:start] + whole[stop:]
    assert "third one" not in got[2]["text"] and got[1]["text"] == passage and got[3]["text"] is None and got[4]["text"] == ""
