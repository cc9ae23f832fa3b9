import re

from veloframe.llm.linededup import dedup_lines

SPACES = " \t\r\x0b\x0c"


def units(text):
    """(line, part): lines, and the sentences or thirds of those with over 50 words."""
    out = []
    for k, line in enumerate(text.split("\n")):
        if len(line.split()) <= 50:
            out.append((k, line))
            continue
        parts = re.split("(?<=[.!?])(?=[ \t])|(?<=[\u3002\uff01\uff1f])", line)
        if sum(bool(p.strip(SPACES)) for p in parts) < 3:
            words = re.split(r"(?<=[ \t-\r])(?=[^ \t-\r])", line)
            n = -(-len(words) // 3)
            parts = ["".join(words[i:i + n]) for i in (0, n, 2 * n)]
        out += [(k, p) for p in parts]
    return out


def brute(rows):
    """The same by a loop over the documents in order; rows equal in id and text are one."""
    first, out = {}, {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out[i, text] = None
            continue
        own = units(text)
        held = [(k, x.strip(SPACES)) for k, (_, x) in enumerate(own) if x.strip(SPACES)]
        cut = set()
        for a in range(len(held) - 2):
            key = tuple(x for _, x in held[a:a + 3])
            if key in first:
                whose, last = first[key]
                start = max(held[a][0], last + 1) if whose == (i, text) else held[a][0]
                cut |= set(range(start, held[a + 2][0] + 1))
            else:
                first[key] = ((i, text), held[a + 2][0])
        left = {}
        for k, (line, x) in enumerate(own):
            if k not in cut:
                left[line] = left.get(line, "") + x
        out[i, text] = "\n".join(left.values())
    return out


def test_agrees_with_a_loop(spark):
    passage = "first line here\nsecond line here\n\n  third line here\nfourth line here"
    rows = [(1, "a\n" + passage + "\nb"), (2, passage), (3, "x\ny\n" + passage), (4, None), (5, ""), (6, "\n\n\n"),
            (7, "l\nl\nl\nl\nl\nl"), (8, "l\nl\nl"), (9, "one\ntwo"), (10, "one\ntwo\nthree"), (10, "one\ntwo\nthree"),
            (11, "one\ntwo\nthree\t"), (None, "one\ntwo\nthree"), (12, "second line here\nthird line here\nfourth line here\nz"),
            (13, "p\nq\nr\ns\nt\nu"), (14, "p\nq\nr\nnew\ns\nt\nu"), (15, "p\nq\nr\ns")]
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], "doc_id long, text string, h string, `a.b` int, cuts int")
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "_lines_cut"]
    found = [(r.doc_id, r.text) for r in got.collect()]
    want = brute(rows)
    assert sorted(found, key=repr) == sorted(((i, want[i, t]) for i, t in rows), key=repr)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_passage_of_all_documents_stays_once(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat('own ', id, '\nu\nv\nw\nend ', id) as text")
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert sum("u\nv\nw" in t for t in got.values()) == 1 and "u\nv\nw" in got[0]
    assert got[7] == "own 7\nend 7"


def test_very_long_text(spark):
    text = "\n".join(f"line {k % 5000}" for k in range(10_000))
    got = dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = brute([(1, text)])[1, text]
    assert got.text == want and got._lines_cut == 10_000 - len(want.split("\n"))


def test_passages_on_one_line(spark):
    sentence = ["{} goes over word after word until it ends here.".format(w) for w in
                "one two three four five six seven eight nine ten".split()]
    passage = " ".join(sentence)
    plain = " ".join(f"w{k}" for k in range(60))
    chinese = " ".join("\u8fd9\u662f\u53e5\u5b50" + str(k) + ("\u3002" if k % 20 == 0 else "") for k in range(60))
    rows = [(1, passage), (2, "own start\n" + passage + "\nown end"), (3, "First. " + passage + " Last one!"), (4, plain),
            (5, "a\n" + plain), (6, plain + "\nb"), (7, plain + " more"), (8, chinese), (9, "x\n" + chinese), (10, "  " + plain),
            (11, " ".join(sentence[:2]) + " " + plain + "."), (12, passage + "\n\n" + passage), (None, plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert got == {i: brute(rows)[i, t] for i, t in rows}
    assert (got[1], got[2], got[3], got[5], got[9]) == (passage, "own start\nown end", "First. Last one!", "a", "x")
    assert got[12] == "" and got[None] == ""


def test_names_that_clash(spark):
    rows = [(1, "u\nv\nw", 5, 6), (2, "u\nv\nw\nx", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _lines_cut int, _units int")
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "_lines_cut_"]
    assert sorted(map(tuple, got.collect())) == [(1, "u\nv\nw", 5, 6, 0), (2, "x", 7, 8, 3)]
