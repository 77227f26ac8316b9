import hashlib
import random
import re

import numpy as np
import sentencepiece

from statloom.llm import sentence_spans, transducer
from tests.llm.helpers import clashing, documents, empty, listed, prose, rows


def brute(table):
    first, found = {}, []
    for doc, text in sorted(((r[0], r[1] or "") for r in table if r[0] is not None), key=lambda r: r[0]):
        parts, place = [], 0
        for m in re.finditer(r"[.!?,;:](?=[ \t\n\v\f\r]|\Z)|\n|\Z", text):
            seg = text[place : m.end()]
            solid = seg.strip(" \t\n\v\f\r")
            if solid:
                begin = place + seg.index(solid)
                parts.append((begin, begin + len(solid)))
            place = m.end()
        runs = []
        for i in range(len(parts)):
            words, j = 0, i - 1
            while j + 1 < len(parts) and (words < 12 or j - i + 1 < 2):
                j += 1
                words += len(re.findall(r"[^ \t\n\v\f\r]+", text[slice(*parts[j])]))
            if words >= 12 and j - i + 1 >= 2:
                run = tuple(text[a:b] for a, b in parts[i : j + 1])
                runs.append((i, j, run))
                first.setdefault(run, (doc, i))
        found.append((doc, text, parts, runs))
    out = []
    for doc, text, parts, runs in found:
        gone = [False] * len(parts)
        for i, j, run in runs:
            if first[run] != (doc, i) and not (first[run][0] == doc and first[run][1] == i):
                gone[i : j + 1] = [True] * (j + 1 - i)
        kept, place, spans = "", 0, 0
        for k, (a, _) in enumerate(parts):
            if gone[k]:
                if not k or not gone[k - 1]:
                    kept += text[place:a]
                    spans += 1
                place = parts[k + 1][0] if k + 1 < len(parts) else len(text)
        out.append((doc, len(parts), sum(gone), spans, hashlib.sha256((kept + text[place:]).encode()).hexdigest()))
    return out


def test_sentence_spans_match_brute_force(spark):
    passage = prose(77, 60)
    more = [(600 + i, prose(100 + i, 30) + " " + passage * (i % 3 > 0) + " " + prose(200 + i, 30)) for i in range(60)]
    table = {r[0]: r for r in rows() + more if r[0] is not None}  # one row for an id
    got = listed(sentence_spans.digest(clashing(documents(spark, more)).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])), "doc_id", "n_sentences", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute(table.values()), key=repr)


def test_sentence_spans_keep_rows(spark):
    out = sentence_spans.deduplicate(documents(spark))
    kept = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert out.count() == len(rows()) and kept[17] is None and kept[10] == rows()[0][1] and kept[11] != rows()[0][1]
    assert sentence_spans.digest(empty(spark)).count() == 0


def test_ids_are_those_of_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=transducer.model_path())
    own = transducer.compiled(transducer.model_path())
    r = random.Random(4)
    letters = list("abc dehlotn ing  ▁\n\t.,é日x0123456789 THE the$#%")
    for n in [*range(40)] * 60:
        text = "".join(r.choice(letters) for _ in range(n))
        ids = own.encode(text)
        assert np.frombuffer(ids, dtype="<i4").tolist() == model.encode(text)
        assert own.decode(ids) == text.replace("▁", " ")
    text = prose(5, 3000)
    assert np.frombuffer(own.encode(text), dtype="<i4").tolist() == model.encode(text)


def test_unigram_path_is_the_best_of_all():
    own = object.__new__(transducer.Transducer)
    own.merges, own.score = False, {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -4.2, "aba": -6.0}
    own.ids = {p: i for i, p in enumerate(own.score)}
    own.arcs = {p[:k]: -1 for p in own.ids for k in range(1, len(p))} | own.ids
    own.byte_ids, own.unknown = {}, 99

    def best(t):
        return min(((best(t[:-n])[0] - own.score[t[-n:]], best(t[:-n])[1] + [own.ids[t[-n:]]]) for n in range(1, len(t) + 1) if t[-n:] in own.score), default=(0, [])) if t else (0, [])

    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice("ab") for _ in range(r.randint(1, 9)))
        ids = np.frombuffer(own.shortest(t), dtype="<i4").tolist()
        names = list(own.score)
        assert abs(-sum(own.score[names[i]] for i in ids) - best(t)[0]) < 1e-9 and "".join(names[i] for i in ids) == t


def test_round_trip_of_odd_rows(spark):
    encoded = transducer.encode(clashing(documents(spark)))
    got = transducer.decode(encoded).toPandas()
    assert len(got) == len(rows())
    assert sorted(map(str, got["text"].where(got["text"].notna(), None))) == sorted(str(r[1]) for r in rows())
    assert transducer.digest(transducer.decode(transducer.encode(empty(spark)))).count() == 0
