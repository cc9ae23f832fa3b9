import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veloframe.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end(), kind, m[0]))
    return sorted(out)


TEXTS = [None, "", "no data here", "a@b.c", "write a@b.c_d@e.f or x.y%z+1@mail-2.example.com.", "@x.y a@b a@.b a@b..c",
         "é\U0001f600 a@b.cd \U0001f600 1.2.3.4", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 1.2.3 and 0000255.000.1.001 99999999999999.1.1.1",
         "4111 1111 1111 1111, 4111-1111-1111-1111; 4111111111111112 4111 1111  1111 1111", "5 5 5 5 12345678901234567890",
         "+1 (499) 555-6503 +49-30-1234567-. ++1 234 567 8901 +1234 +1.(2)3", "+123456789012345678 x +1 234 567 890 1234 (",
         "1" * 3000 + ".1.1.1 " + "a" * 3000 + "@b" + ".c" * 3000, "9" * 5000, "a" * 50_000, "1-" * 5000 + "1", "+1" + "." * 3000 + "2"]


def test_base_spans_agree_with_plain_patterns(spark):
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(TEXTS)] + [(None, "a@b.c", 0), (3, "a@b.c", 0)],
                                 "doc_id long, text string, n_email int")
    got = pii.digest(pii.detect(docs)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        found = brute_base("a@b.c" if r.doc_id is None else TEXTS[r.doc_id])
        text = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind, _ in found)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), r.doc_id
        n = Counter(f[3] for f in found)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [n[k] for k in pii.KINDS]
        assert r.spans == text
    assert pii.digest(pii.detect(docs.limit(0))).count() == 0


def brute_terms(texts):
    """(text number, start, end, action) of all terms that give an entity away, with the shipped parameters."""
    n_term, n_entity, both, words, base = Counter(), Counter(), Counter(), [], [brute_base(t) for t in texts]
    for k, t in enumerate(texts):
        words.append([(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")])
        n_term.update({w for _, _, w in words[k]})
        n_entity.update({b[3:] for b in base[k]})
        free = {w for s, e, w in words[k] if not any(b[0] < e and s < b[2] for b in base[k])}
        both.update({(w, *v) for w in free for v in {b[3:] for b in base[k]}})
    best = defaultdict(float)
    for (w, *v), n in both.items():
        p = n / (n_term[w] + 2)
        if math.log2(p * len(texts) / n_entity[tuple(v)]) >= 3:
            best[w] = max(best[w], p)
    return {(k, s, e, "remove" if best[w] >= 0.8 else "generalise") for k in range(len(texts)) for s, e, w in words[k]
            if best[w] >= 0.5 and not any(b[0] < e and s < b[2] for b in base[k])}


def corpus(n):
    """Twelve clerks' letters with one address, one name beside a number, and texts without any."""
    texts = [f"the clerk zorblatt wrote from z@corp.example to the desk number {k}" for k in range(12)]
    texts += [f"call 李明 or once{k} at +49 30 1234560 today" for k in range(6)]
    texts += ["李明 alone, far from any value", "zorblatt again", "10.0.0.7 hapax beside an address", None, ""]
    return texts + [f"the desk was clear on day {k} and nobody wrote, called or sent a letter or number to it" for k in range(n - len(texts))]


@pytest.mark.parametrize("n", [200, 1000, 10_000])
def test_revealing_terms(spark, n):
    texts = corpus(n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.detect(docs)
    got = {(r.doc_id, t.start, t.end, t.action) for r in found.collect() for t in r.terms}
    assert got == brute_terms(texts)
    # the verdict is the same at every size
    assert {texts[k][a:b] for k, a, b, _ in got} == {"zorblatt", "李明", "clerk", "wrote", "from", "call", "at", "today"}
    assert {k for k, a, b, _ in got if texts[k][a:b] == "李明"} == {*range(12, 18), 18} and not any(k == 20 for k, *_ in got)
    clean = docs.join(found.drop("row"), "doc_id").select("doc_id", pii.sanitise(F.col("text"), F.col("base"), F.col("terms")).alias("t"))
    by = {r.doc_id: r.t for r in clean.where("doc_id < 40").collect()}
    assert "[EMAIL]" in by[0] and "zorblatt" not in by[0] and "@" not in by[0] and "zorblatt" not in by[19]
    assert by[30] == texts[30] and "hapax" in by[20]


def test_places_of_words_in_long_texts(spark):
    text = " a  bb\n" + "\U0001f600word\t" * 300 + "end"
    rows = pii.placed_words(spark.createDataFrame([(text,), ("",)], "text string")).select("text", "words").collect()
    assert [(w.term, w.start, w.end) for w in rows[0].words] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    assert rows[1].words == []
