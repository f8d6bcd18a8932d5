"""Prompts as columns. The wording is fixed, so that runs can be compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of the prompts.
BENCHMARK = "You are answering a medical multiple-choice benchmark question. "
PLAIN = (
    "You have no external documents or retrieval context. "
    "Choose the single best option using only your general knowledge.\n\nQuestion:\n"
)
GROUNDED = (
    "Use the retrieved evidence below when it is relevant. Do not invent citations. "
    "Choose the single best option.\n\nQuestion:\n"
)
SHAPE = "Return only valid JSON in this exact shape: "
GROUNDED_SHAPE = '{"answer": "A", "citations": ["chunk_id"]}. '
CITED = ". The citations array must contain only IDs from the allowed citation chunk IDs."
EXAM = "You are a medical expert taking the USMLE clinical examination.\n\nQuestion:\n"
EXAM_END = (
    "\n\nInstructions: Think carefully and select the best option. Clearly state the correct option letter "
    "(A, B, C, D, or E) and provide a brief clinical justification.\nFinal Answer:"
)
CONTEXT_RELEVANCE = (
    "Rate the relevance of the following context to the query on a scale of 1 to 5, where 1 is completely "
    "irrelevant and 5 is perfectly relevant. Only output the number.\n\nQuery: "
)
FAITHFULNESS = (
    "Given the following context and an answer, rate from 0.0 to 1.0 how faithful the answer is to the context. "
    "A score of 1.0 means all claims in the answer are supported by the context. A score of 0.0 means none are "
    "supported. Only output the numeric score.\n\nContext:\n"
)
ANSWER_RELEVANCE = (
    "Rate the relevance of the following answer to the given question on a scale of 0.0 to 1.0, where 1.0 is "
    "perfectly relevant and directly answers the question, and 0.0 is completely irrelevant. Only output the "
    "numeric score.\n\nQuestion:\n"
)
HALLUCINATION = (
    "Analyze the answer based on the context. Provide a score from 0.0 to 1.0 representing the fraction of claims "
    "in the answer that are NOT supported by the context (i.e., hallucinations). 0.0 means no hallucination, 1.0 "
    "means fully hallucinated. Only output the numeric score.\n\nContext:\n"
)
UNIT_SCORE = "\n\nScore (0-1):"


def option_lines(options: Column) -> Column:
    return F.concat_ws("\n", F.transform(options, lambda o: F.concat(o["label"], F.lit(". "), o["text"])))


def _labels(options: Column) -> Column:
    return F.concat_ws(", ", F.transform(options, lambda o: o["label"]))


def plain_prompt(question: Column, options: Column) -> Column:
    """Without retrieval; the example answer is the first label."""
    first = F.get(F.transform(options, lambda o: o["label"]), F.lit(0))
    return F.concat(
        F.lit(BENCHMARK + PLAIN), question, F.lit("\n\nOptions:\n"), option_lines(options), F.lit("\n\n" + SHAPE + '{"answer": "'),
        first, F.lit('"}. The answer value must be exactly one of: '), _labels(options), F.lit("."),
    )


def grounded_prompt(question: Column, options: Column, retrieved: Column) -> Column:
    """With the retrieved chunks (``chunk_id, title, text`` in rank order) and the ids that may be cited."""
    blocks = F.transform(retrieved, lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit("] "), c["title"], F.lit("\n"), c["text"]))
    ids = F.concat_ws(", ", F.transform(retrieved, lambda c: c["chunk_id"]))
    return F.concat(
        F.lit(BENCHMARK + GROUNDED), question, F.lit("\n\nOptions:\n"), option_lines(options), F.lit("\n\nRetrieved evidence:\n"),
        F.concat_ws("\n\n", blocks), F.lit("\n\nAllowed citation chunk IDs: "), ids, F.lit("\n" + SHAPE + GROUNDED_SHAPE),
        F.lit("The answer must be exactly one of: "), _labels(options), F.lit(CITED),
    )


def exam_prompt(question: Column, options: Column) -> Column:
    """Exam style, options by label."""
    return F.concat(F.lit(EXAM), question, F.lit("\n\nOptions:\n"), option_lines(F.array_sort(options)), F.lit(EXAM_END))


def response_schema(options: Column, retrieved: Column) -> Column:
    """The JSON schema that a grounded response has to meet, as a JSON string."""
    text = F.lit("string").alias("type")
    answer = F.struct(text, F.transform(options, lambda o: o["label"]).alias("enum"))
    item = F.struct(text, F.transform(retrieved, lambda c: c["chunk_id"]).alias("enum"))
    citations = F.struct(F.lit("array").alias("type"), item.alias("items"), F.lit(1).alias("minItems"))
    return F.to_json(
        F.struct(
            F.lit("object").alias("type"),
            F.lit(False).alias("additionalProperties"),
            F.struct(answer.alias("answer"), citations.alias("citations")).alias("properties"),
            F.array(F.lit("answer"), F.lit("citations")).alias("required"),
        )
    )


def judge_prompts(question: Column, answer: Column, context: Column) -> dict[str, Column]:
    """Prompts for a judging model, by score name."""
    return {
        "context_relevance": F.concat(F.lit(CONTEXT_RELEVANCE), question, F.lit("\n\nContext:\n"), context, F.lit("\n\nScore (1-5):")),
        "faithfulness": F.concat(F.lit(FAITHFULNESS), context, F.lit("\n\nAnswer:\n"), answer, F.lit(UNIT_SCORE)),
        "answer_relevance": F.concat(F.lit(ANSWER_RELEVANCE), question, F.lit("\n\nAnswer:\n"), answer, F.lit(UNIT_SCORE)),
        "hallucination": F.concat(F.lit(HALLUCINATION), context, F.lit("\n\nAnswer:\n"), answer, F.lit(UNIT_SCORE)),
    }
