"""Model calls by a table of responses, and judges whose calls fail."""

from collections import Counter

import pytest

from quarrymill.functions import overlap
from quarrymill.operators import generate


def counting(folder, fail_at=None):
    """A model that leaves a file for each call, and breaks down at one prompt if told to."""

    def make():
        import pathlib
        import uuid

        def answer(prompt):
            if prompt == fail_at:
                raise KeyError(prompt)
            (pathlib.Path(folder) / f"{prompt}-{uuid.uuid4().hex}").touch()
            if prompt == "bad":
                raise ValueError("refused")
            return f"said {prompt}"

        return answer

    return make


def test_no_prompt_is_called_twice(spark, tmp_path):
    calls, store = tmp_path / "calls", f"file://{tmp_path}/store"
    calls.mkdir()
    rows = [(i, f"p{i % 20}") for i in range(60)] + [(60, "bad"), (61, None), (62, "bad")]
    asked = spark.createDataFrame(rows, "id int, prompt string").repartition(4)
    with pytest.raises(Exception, match="KeyError"):
        generate.answered(asked, counting(str(calls), "p7"), store).collect()
    assert not any(p.name.startswith("p7-") for p in calls.iterdir())
    for _ in range(2):  # a run after the failed one, and one that finds all responses
        got = {r.id: r for r in generate.answered(asked, counting(str(calls)), store).collect()}
        assert set(Counter(p.name.rpartition("-")[0] for p in calls.iterdir()).values()) == {1}
    assert all(got[i].raw_response == f"said p{i % 20}" and got[i].call_error is None for i in range(60))
    assert got[60].call_error == got[62].call_error == "ValueError: refused" and got[61].call_error == "no prompt"
    assert generate.responses(spark, store).count() == 21 and len(list(calls.iterdir())) == 21
    assert not (tmp_path / "store" / "journal").exists()


def test_failed_judgements_say_why(spark):
    def make():
        def answer(prompt):
            if "fail" in prompt:
                raise OSError("gone")
            return "0.5"

        return answer

    rows = spark.createDataFrame([(1, "fail"), (2, "x")], "id int, prompt string")
    got = {r.id: r for r in generate.judge(rows, {"faithfulness": rows.prompt}, make).collect()}
    assert (got[1].faithfulness, got[1].faithfulness_error) == (None, "OSError: gone") and (got[2].faithfulness, got[2].faithfulness_error) == (0.5, None)


def test_common_subsequence_against_the_table():
    import random

    chance = random.Random(3)
    for _ in range(300):
        a, b = ([chance.choice("abcde") for _ in range(chance.randrange(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *row[1:]] if not b else _next(row, x, b)
        assert overlap.common_subsequence(a, b) == row[-1]


def _next(row, x, b):
    new = [0]
    for k, y in enumerate(b):
        new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
    return new


@pytest.mark.parametrize(
    "word, stem",
    [("dying", "die"), ("skies", "sky"), ("news", "news"), ("dies", "die"), ("died", "die"), ("flies", "fli"), ("cried", "cri"), ("enjoy", "enjoy"), ("happy", "happi"),
     ("biology", "biolog"), ("possibly", "possibl"), ("succeed", "succeed"), ("agreed", "agre"), ("hopping", "hop"), ("relational", "relat"), ("generally", "gener"), ("by", "by")],
)
def test_stems_with_the_common_extensions(word, stem):
    assert overlap.stem(word) == stem
