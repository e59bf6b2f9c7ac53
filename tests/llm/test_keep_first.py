"""One text of each class stays, also where ids repeat or are null."""

import random

from flowtide.llm import ngram_join

from .helpers import documents, prose


def test_one_text_of_a_class_stays_when_its_texts_share_an_id_or_have_none(spark):
    rng = random.Random(31)
    texts, ids = [], []
    for k, own in enumerate(((7, 7, 7), (None, None, None), (None, 9, 9), (3, 4, 5))):
        words = " ".join(prose(rng, 200).split()).split(" ")
        for i, doc_id in enumerate(own):
            near = list(words)
            near[40 * (i + 1)] = f"changed{i}"
            texts.append(" ".join([f"class{k}", *near]))
            ids.append(doc_id)
    docs = documents(spark, texts + [texts[0], texts[3], None, ""], ids=ids + [7, None, None, None])
    kept = ngram_join.keep_first(docs).collect()
    worded = sorted((r.text.split(" ")[0], r.doc_id) for r in kept if r.text)
    assert [c for c, _ in worded] == ["class0", "class1", "class2", "class3"]
    assert [i for _, i in worded] == [7, None, 9, 3]
    assert len(kept) == 6
