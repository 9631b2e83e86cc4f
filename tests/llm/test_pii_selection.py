import numpy as np

from tabsmith.llm import pii

from .conftest import DOCS, words


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).repartition(3)


def test_few_candidates_and_many_copies_still_select(spark):
    plain = [f"{words(i, 20)} write to user{i}@host{i}.example.org soon {words(i + 50, 9)}" for i in range(12)]
    copies = [f"{words(1, 20)} run 9859476043669043 {words(2, 9)}"] * 400
    spelled = "please write to jane.doe (at) mail.example (dot) org and to joe [at] example.org today"
    docs = docs_of(spark, plain + copies + [spelled])
    model = pii.train(docs)
    assert np.isfinite(model.limits[0])
    found = [spelled[a:b] for a, k, b, base in pii.spans_of(spelled, model) if k == 0 and not base]
    assert found == ["jane.doe (at) mail.example (dot) org", "joe [at] example.org"]
    assert pii.spans_of(copies[0], model) == []


def test_positives_are_no_base_spans():
    for text in ("mail a.b@c.example.org now", "from 10.0.0.1 login", "card 4111 1111 1111 1111 paid", "call +1 (555) 010-9999 now", "ring +49 3012345 now"):
        (base,) = pii.base_spans(text)
        assert [(k, y) for k, y, _ in pii.examples(text) if y] == [(base[1], 1)]
        new = text[: base[0]] + pii._rewritten(text[base[0] : base[2]], base[1], 0) + text[base[2] :]
        assert pii.base_spans(new) == []
    assert all(y == 0 for _, y, _ in pii.examples("run 9859476043669043, version 300.1.1.1, see you @ home. Then on 2023 11 05"))


def test_candidates_beside_base_spans():
    text = "a@b.co (at) c.org 4111.1111.1111.1111 4111 1111 1111 1111 x (at) y.org"
    base = pii.base_spans(text)
    assert pii.addable(text, base) == [c for c in pii.candidates(text) if not any(a < c[2] and c[0] < b for a, _, b in base)]


def test_limit_takes_any_count():
    assert pii._limit({(9, 1): 1}) == 9
    assert pii._limit({(9, 1): 20, (5, 0): 1, (3, 1): 1, (2, 0): 5}) == 3
    assert pii._limit({(9, 0): 1}) == np.inf and pii._limit({}) == np.inf
