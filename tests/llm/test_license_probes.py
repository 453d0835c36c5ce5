"""No text that meets a template's rule of acceptance is missed, whatever the word frequencies."""

from maskwright.llm import licenses


def test_first_words_of_a_template_suffice(spark):
    label, text, phrase = next(t for t in licenses.TEMPLATES if t[0] == "mit")
    words = text.split()
    head = words[: -(-6 * len(words) // 10)]
    assert phrase in " ".join(head)
    rows = [(1, " ".join(head) + " x" * 10)] + [(d, " ".join(head)[: 40 + d]) for d in range(2, 30)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert label in got[1].split(",")
