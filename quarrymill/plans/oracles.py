"""The queries in DuckDB SQL over views of the same tables."""

from __future__ import annotations

from quarrymill.functions import answers
from quarrymill.functions import prompts as P
from quarrymill.functions.scope import RULES
from quarrymill.operators.generate import NO_CITATIONS, NO_LABEL
from quarrymill.plans.adapters import PHRASES

TERMS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
K, KS, WIDTH = 3, (1, 3, 5, 8), 32

BM25 = f"""
tok AS (SELECT doc_id AS pos, unnest({TERMS.format("text")}) AS term FROM documents),
dl AS (SELECT doc_id AS pos, len({TERMS.format("text")}) AS dl FROM documents),
post AS (SELECT pos, term, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
i0 AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM post, st GROUP BY term, n),
idf AS (SELECT term, df, CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25 * (SELECT avg(idf0) FROM i0) END AS idf FROM i0),
q AS (SELECT item_id AS question_id, unnest({TERMS.format("text")}) AS term FROM benchmark),
sc AS (
    SELECT question_id, pos, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
    FROM q JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (pos), st GROUP BY ALL
),
bm AS (
    SELECT b.item_id AS question_id, d.doc_id::VARCHAR AS chunk_id, coalesce(score, 0.0) AS score,
           row_number() OVER (PARTITION BY b.item_id ORDER BY coalesce(score, 0.0) DESC, d.doc_id)::INT AS rank
    FROM benchmark b CROSS JOIN documents d LEFT JOIN sc ON sc.question_id = b.item_id AND sc.pos = d.doc_id
    QUALIFY rank <= {max(KS)}
)"""

_BUCKET = f"('0x' || substr(md5(term), 1, 8))::BIGINT % {WIDTH}"
DENSE = f"""
hd AS (SELECT pos, {_BUCKET} AS b, count(*) AS n FROM tok GROUP BY ALL),
hq AS (SELECT question_id, {_BUCKET} AS b, count(*) AS n FROM q GROUP BY ALL),
nd AS (SELECT pos, sqrt(sum(n * n)) AS l FROM hd GROUP BY pos),
nq AS (SELECT question_id, sqrt(sum(n * n)) AS l FROM hq GROUP BY question_id),
cs AS (
    SELECT question_id, pos, round(sum((hq.n / nq.l) * (hd.n / nd.l)), 9) AS score
    FROM hq JOIN nq USING (question_id) JOIN hd USING (b) JOIN nd USING (pos) GROUP BY ALL
),
dn AS (
    SELECT b.item_id AS question_id, d.doc_id::VARCHAR AS chunk_id,
           row_number() OVER (PARTITION BY b.item_id ORDER BY coalesce(score, 0.0) DESC, d.doc_id)::INT AS rank
    FROM benchmark b CROSS JOIN documents d LEFT JOIN cs ON cs.question_id = b.item_id AND cs.pos = d.doc_id
    QUALIFY rank <= {max(KS)}
)"""

_KLIST = ", ".join(f"({k})" for k in KS)
FUSED = f"""
ks AS (SELECT * FROM (VALUES {_KLIST}) t(k)),
fa AS (SELECT k, question_id, chunk_id, rank FROM bm, ks WHERE rank <= k),
fb AS (SELECT k, question_id, chunk_id, rank FROM dn, ks WHERE rank <= k),
ff AS (
    SELECT k, question_id, chunk_id, round(coalesce(1::DOUBLE / (60 + fa.rank), 0) + coalesce(1::DOUBLE / (60 + fb.rank), 0), 12) AS score
    FROM fa FULL JOIN fb USING (k, question_id, chunk_id)
),
fu AS (
    SELECT k, question_id, chunk_id, row_number() OVER (PARTITION BY k, question_id ORDER BY score DESC, chunk_id)::INT AS rank, score
    FROM ff QUALIFY rank <= k
)"""

RANKED = f"""
gold AS (SELECT item_id AS question_id, doc_id::VARCHAR AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ng AS (SELECT question_id, count(*) AS ng FROM gold GROUP BY ALL),
hit AS (SELECT question_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS nth FROM bm JOIN gold USING (question_id, chunk_id) WHERE rank <= {K}),
hs AS (
    SELECT question_id, count(*) AS h, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg, sum(nth / rank) AS gains FROM hit GROUP BY ALL
),
m AS (
    SELECT b.item_id AS question_id, coalesce(ng, 0) AS ng, coalesce(h, 0) AS h, coalesce(1 / first, 0) AS rr, coalesce(dcg, 0) AS dcg,
           coalesce(gains, 0) AS gains,
           CASE least(coalesce(ng, 0), {K}) WHEN 1 THEN 1 WHEN 2 THEN 1 + 1 / log2(3) WHEN 3 THEN 1 + 1 / log2(3) + 0.5 END AS ideal
    FROM benchmark b LEFT JOIN ng ON ng.question_id = b.item_id LEFT JOIN hs ON hs.question_id = b.item_id
)"""


def _letter(column: str) -> str:
    return f"['A', 'B', 'C', 'D', 'E'][{column} % 5 + 1]"


ROWS = f"""
e AS (
    SELECT event_id AS question_id, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS system_name,
           CASE WHEN event_type <> 'click' THEN event_type ELSE 'unannotated' END AS scope,
           CASE WHEN event_id % 17 <> 0 THEN value END AS latency_ms,
           event_id % 9 <> 4 AS ok,
           CASE WHEN event_id % 13 <> 0 THEN {_letter("event_id")} END AS predicted_answer,
           {_letter("user_id")} AS expected_answer,
           ['c' || ((user_id + 3) % 11), 'c' || ((user_id + 6) % 11), 'c' || ((user_id + 9) % 11), 'c' || ((user_id + 12) % 11)][1:event_id % 5] AS ids,
           ['c' || (user_id % 11), 'c3'][1:event_id % 3] AS cited,
           CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 11 = 1 THEN ['c1'] ELSE ['c' || (event_id % 11), 'c1'] END END AS gold
    FROM events
),
r AS (
    SELECT *, coalesce(ok AND predicted_answer = expected_answer, false) AS is_right, len(cited) > 0 AS has_cited,
           ok AND len(cited) > 0 AND list_has_all(ids, cited) AS valid,
           coalesce(list_contains(gold, ids[1]), false)::INT AS h1, coalesce(list_contains(gold, ids[2]), false)::INT AS h2,
           coalesce(list_contains(gold, ids[3]), false)::INT AS h3, least(len(ids), 3) AS n_ids
    FROM e
),
x AS (
    SELECT *, CASE WHEN gold IS NOT NULL THEN (h1 + h2 + h3) / len(gold) END AS recall,
           CASE WHEN gold IS NOT NULL THEN coalesce((h1 + h2 + h3) / nullif(n_ids, 0), 0) END AS prec,
           CASE WHEN gold IS NOT NULL THEN CASE WHEN h1 = 1 THEN 1.0 WHEN h2 = 1 THEN 1 / 2 WHEN h3 = 1 THEN 1 / 3 ELSE 0 END END AS rr,
           CASE WHEN gold IS NOT NULL THEN (h1 + h2 / log2(3) + h3 / 2) / CASE len(gold) WHEN 1 THEN 1 ELSE 1 + 1 / log2(3) END END AS nd
    FROM r
)"""


def _wilson(sign: str) -> str:
    p, n = "(count(*) FILTER (is_right) / count(*))", "count(*)"
    z2 = "(1.96::DOUBLE * 1.96::DOUBLE)"
    return f"(({p} + {z2} / {n} / 2) / (1 + {z2} / {n}) {sign} 1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})) / (1 + {z2} / {n}))"


_CI_LOW, _CI_HIGH = f"round_even(greatest(0.0, {_wilson('-')}), 6)", f"round_even(least(1.0, {_wilson('+')}), 6)"
_WORDS = {"the": "the", "and": "and", "die": "die", "que": "que", "tion": "tion[a-z0-9_]*"}


def _rules(text: str) -> str:
    """Word rules on ASCII and Latin letters; a word character next to a rule's word forbids it."""
    edge = "[^\\w\\x{00C0}-\\x{024F}]"
    tests = [f"CASE WHEN regexp_matches({text}, '(?i)(^|{edge}){p}($|{edge})') THEN '{n}' END" for n, p in _WORDS.items() if n != "tion"]
    tests.append(f"CASE WHEN regexp_matches({text}, '(?i)(^|{edge})tion') THEN 'tion' END")
    return f"concat_ws(',', {', '.join(tests)})"


SCOPED = f"s AS (SELECT doc_id AS question_id, {_rules('text')} AS matched_terms FROM documents)"
_SENTENCES = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_WSWORDS = "regexp_extract_all(lower({0}), '[^\\s]+')"



def _text(value: str) -> str:
    """A string in SQL."""
    return "'" + value.replace("'", "''") + "'"


def _first(text: str, patterns: list[tuple[str, bool]]) -> str:
    """The letter of the first pattern that matches, upper-cased."""
    tried = [f"nullif(regexp_extract({text}, {_text(('(?i)' if loose else '') + p)}, 1), '')" for p, loose in patterns]
    return f"upper(coalesce({', '.join(tried)}, ''))"


#: What the stand-in models say, word for word.
SAID = f"""
p AS (SELECT event_id, user_id, {_letter("user_id")} AS truth_letter, {_letter("event_id")} AS said, event_id % 6 AS n FROM events),
rs AS (
    SELECT event_id, truth_letter, said,
           CASE n WHEN 0 THEN 'The answer is ' || said || '. Because of x.' WHEN 1 THEN said || ') as the text says'
                  WHEN 2 THEN 'I would take **' || said || '** here' WHEN 3 THEN 'no idea'
                  WHEN 4 THEN 'correct option is ' || lower(said) ELSE 'It must be ' || said END AS response
    FROM p
)"""
EXCHANGES = """
c AS (
    SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question,
           list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS contexts
    FROM conversations
),
x AS (
    SELECT conv_id, turn, question, text AS answer, contexts, array_to_string(contexts, chr(10)) AS context,
           [turn % 3 + 1, 0, 1][1:turn % 4] AS cited
    FROM c WHERE role = 'assistant' AND question IS NOT NULL
)"""


def _judge(parts: list[str], five: bool = False) -> str:
    """The stand-in judge: it goes by the prompt's length, and fails at multiples of 11."""
    n = "(" + " + ".join(f"length({p})" for p in parts) + ")"
    said = f"round({n} % 7 * 0.2::DOUBLE, 1)"
    score = f"(greatest(1.0, least(5.0, {said})) - 1) / 4" if five else f"least(1.0, {said})"
    return f"CASE WHEN {n} % 11 <> 0 THEN ({score})::DOUBLE END"


_CONTEXT, _ANSWER, _UNIT = _text("\n\nContext:\n"), _text("\n\nAnswer:\n"), _text(P.UNIT_SCORE)
JUDGED = f"""
j AS (
    SELECT conv_id, turn, question, answer,
           {_judge([_text(P.CONTEXT_RELEVANCE), "question", _CONTEXT, "context", _text(chr(10) * 2 + "Score (1-5):")], five=True)} AS context_relevance,
           {_judge([_text(P.FAITHFULNESS), "context", _ANSWER, "answer", _UNIT])} AS faithfulness,
           {_judge([_text(P.ANSWER_RELEVANCE), "question", _ANSWER, "answer", _UNIT])} AS answer_relevance,
           {_judge([_text(P.HALLUCINATION), "context", _ANSWER, "answer", _UNIT])} AS hallucination
    FROM x
)"""
_OPTIONS = _text("\n\nOptions:\nB. second\nA. first\nC. third")
_PLAIN = f"""{_text(P.BENCHMARK + P.PLAIN)} || question || {_OPTIONS} || {_text(chr(10) * 2 + P.SHAPE + '{"answer": "B"}. The answer value must be exactly one of: B, A, C.')}"""
_GROUNDED = f"""{_text(P.BENCHMARK + P.GROUNDED)} || question || {_OPTIONS} || {_text(chr(10) * 2 + "Retrieved evidence:" + chr(10))} || blocks
        || {_text(chr(10) * 2 + "Allowed citation chunk IDs: ")} || ids || {_text(chr(10) + P.SHAPE + P.GROUNDED_SHAPE + "The answer must be exactly one of: B, A, C" + P.CITED)}"""
_EXAM = f"""{_text(P.EXAM)} || question || {_text(chr(10) * 2 + "Options:" + chr(10) + "A. first" + chr(10) + "B. second" + chr(10) + "C. third" + P.EXAM_END)}"""
_ROW_TERMS, _NAMED = TERMS.format("s"), ", ".join(f"CASE WHEN regexp_matches(t, {_text('(?i)' + p)}) THEN {_text(n)} END" for n, p in RULES)
_STRICT = [(f"(?m){pattern.pattern}", True) for pattern in answers.LINES]

ORACLES: dict[str, str] = {
    "grounding": f"""
        WITH {EXCHANGES},
        g AS (
            SELECT conv_id, turn, cited, list_distinct({TERMS.format("question")}) AS asked, [list_distinct({_ROW_TERMS}) for s in contexts] AS seen,
                   [list_distinct({_ROW_TERMS}) for s in {_SENTENCES.format("answer")} if trim(s) <> ''] AS claims,
                   list_distinct(flatten([{TERMS.format("contexts[i]")} for i in cited if i >= 1 AND i <= len(contexts)])) AS evidence
            FROM x
        ),
        h AS (
            SELECT *, len(claims) AS n_claims, len([w for w in claims if len(w) > 0 AND len(list_intersect(w, evidence)) / greatest(len(w), 1) >= 0.15]) AS n_supported,
                   [coalesce(len(list_intersect(asked, w)) / nullif(len(asked), 0), 0) for w in seen] AS cover
            FROM g
        )
        SELECT conv_id, turn, n_claims::INT AS n_claims, n_supported::INT AS n_supported, (n_claims - n_supported)::INT AS n_unsupported, len(cited) = 0 AS uncited,
               round(coalesce(n_supported / nullif(n_claims, 0), 0), 9) AS faithfulness,
               round(coalesce((n_claims - n_supported) / nullif(n_claims, 0), 0), 9) AS hallucination_rate,
               round(coalesce(list_sum(cover) / nullif(len(cover), 0), 0), 9) AS mean_relevance, round(coalesce(list_max(cover), 0), 9) AS max_relevance
        FROM h""",
    "judge_scores": f"""
        WITH {EXCHANGES}, {JUDGED}
        SELECT conv_id, turn, round(context_relevance, 9) AS context_relevance, round(faithfulness, 9) AS faithfulness,
               round(answer_relevance, 9) AS answer_relevance, round(hallucination, 9) AS hallucination
        FROM j""",
    "generation_metrics": f"""
        WITH {EXCHANGES}, {JUDGED},
        w AS (SELECT *, {_WSWORDS.format("answer")} AS p, {_WSWORDS.format("question")} AS t FROM j),
        f AS (SELECT *, len(list_distinct(list_intersect(p, t))) AS common FROM w)
        SELECT count(*) AS n, round(avg((lower(trim(answer)) = lower(trim(question)))::INT), 9) AS exact_match,
               round(avg(CASE WHEN common > 0 THEN 2 * (common / len(p)) * (common / len(t)) / (common / len(p) + common / len(t)) ELSE 0 END), 9) AS f1_score,
               round(avg(faithfulness), 9) AS faithfulness, round(avg(answer_relevance), 9) AS answer_relevance, round(avg(hallucination), 9) AS hallucination
        FROM f""",
    "prompts": f"""
        WITH {BM25},
        r AS (
            SELECT bm.question_id, string_agg('[' || chunk_id || '] ' || source || chr(10) || d.text, chr(10) || chr(10) ORDER BY rank) AS blocks,
                   string_agg(chunk_id, ', ' ORDER BY rank) AS ids
            FROM bm JOIN documents d ON d.doc_id::VARCHAR = chunk_id WHERE rank <= {K} GROUP BY 1
        ),
        z AS (SELECT question_id, b.text AS question, blocks, ids FROM r JOIN benchmark b ON b.item_id = question_id)
        SELECT question_id, md5({_PLAIN}) AS plain, md5({_GROUNDED}) AS grounded, md5({_EXAM}) AS exam, length({_GROUNDED})::INT AS n_chars,
               '{{"type":"object","additionalProperties":false,"properties":{{"answer":{{"type":"string","enum":["B","A","C"]}},"citations":{{"type":"array",'
               || '"items":{{"type":"string","enum":["' || replace(ids, ', ', '","') || '"]}},"minItems":1}}}},"required":["answer","citations"]}}' AS schema
        FROM z""",
    "parse_responses": f"""
        WITH {SAID},
        q AS (
            SELECT event_id, truth_letter, event_id % 10 = 9 AS gone,
                   CASE event_id % 4 WHEN 0 THEN '{{"answer": "' || truth_letter || '", "citations": ["c1", "c1"]}}' WHEN 1 THEN 'Thus {{"answer": "a", "citations": ["c9"]}}'
                        ELSE response END AS raw
            FROM rs
        ),
        a AS (
            SELECT *, CASE WHEN NOT gone THEN nullif(coalesce(nullif(upper(regexp_extract(raw, '"answer": "([A-Ea-e])"', 1)), ''), {_first("raw", _STRICT)}), '') END AS letter,
                   list_distinct(regexp_extract_all(regexp_extract(raw, '"citations": \\[([^]]*)\\]', 1), '[a-z0-9]+')) AS cited
            FROM q
        ),
        e AS (
            SELECT *, CASE WHEN gone THEN 'OSError: gone' WHEN letter IS NULL THEN {_text(NO_LABEL)}
                           WHEN NOT coalesce(len(cited) > 0 AND list_has_all(['c1', 'c2'], cited), false) THEN {_text(NO_CITATIONS)} END AS error
            FROM a
        )
        SELECT event_id, letter AS predicted_answer, CASE WHEN error IS NULL THEN array_to_string(cited, ',') ELSE '' END AS citations, error,
               CASE WHEN error IS NULL THEN letter = truth_letter END AS is_correct
        FROM e""",
    "batch_embed": f"""
        WITH t AS (SELECT doc_id, coalesce(trim(text), '') = '' AS blank, [ord(c) % 8 for c in regexp_extract_all(text, '(?s).')] AS m FROM documents)
        SELECT doc_id, CASE WHEN NOT blank THEN concat_ws(',', {", ".join(f"len([x for x in m if x = {k}])" for k in range(8))}) END AS embedding,
               CASE WHEN blank THEN 'blank text' END AS reject
        FROM t""",
    "bleu": f"""
        WITH {EXCHANGES},
        w AS (SELECT conv_id, turn, {_WSWORDS.format("answer")} AS p, {_WSWORDS.format("question")} AS t FROM x),
        g AS (
            SELECT conv_id, turn, size, unnest([array_to_string(p[i:i + size - 1], ' ') for i in range(1, len(p) - size + 2)]) AS gram, true AS own
            FROM w, range(1, 5) s(size) WHERE len(p) >= size
            UNION ALL
            SELECT conv_id, turn, size, unnest([array_to_string(t[i:i + size - 1], ' ') for i in range(1, len(t) - size + 2)]), false
            FROM w, range(1, 5) s(size) WHERE len(t) >= size
        ),
        k AS (SELECT conv_id, turn, size, gram, least(count(*) FILTER (own), count(*) FILTER (NOT own)) AS n FROM g GROUP BY ALL),
        m AS (SELECT conv_id, turn, size, sum(n) AS n FROM k GROUP BY ALL),
        h AS (
            SELECT conv_id, turn, s.size, coalesce(n, 0) AS n, len(p) AS lp, len(t) AS lt
            FROM w CROSS JOIN range(1, 5) s(size) LEFT JOIN m USING (conv_id, turn, size)
        )
        SELECT conv_id, turn, round(CASE WHEN max(n) FILTER (size = 1) > 0 THEN
                   CASE WHEN any_value(lp) > any_value(lt) THEN 1.0::DOUBLE ELSE exp(1 - any_value(lt) / any_value(lp)) END
                   * exp(sum(ln(CASE WHEN n > 0 THEN n::DOUBLE ELSE 0.1::DOUBLE END / greatest(1, lp - size + 1)) / 4)) ELSE 0 END, 9) AS bleu
        FROM h GROUP BY conv_id, turn""",
    "generate_answers": f"""
        WITH z AS (SELECT item_id AS question_id, text AS question, ['B', 'A', 'C'][item_id % 3 + 1] AS expected FROM benchmark),
        a AS (SELECT *, length({_PLAIN}) AS n FROM z),
        b AS (SELECT *, n % 7 = 0 AS gone, ['A', 'B', 'C', 'D'][n % 4 + 1] AS letter FROM a)
        SELECT question_id, CASE WHEN NOT gone THEN 'Answer: ' || letter END AS raw_response, CASE WHEN NOT gone AND letter <> 'D' THEN letter END AS predicted_answer,
               CASE WHEN gone THEN 'RuntimeError: no answer' WHEN letter = 'D' THEN {_text(NO_LABEL)} END AS error,
               CASE WHEN NOT gone AND letter <> 'D' THEN letter = expected END AS is_correct
        FROM b""",
    "benchmark_document": f"""
        WITH {SAID},
        r AS (SELECT event_id, truth_letter, CASE WHEN event_id % 10 = 9 THEN '[ERROR: Generation failed: gone]' ELSE response END AS response FROM rs),
        l AS (SELECT *, {_first("response", answers.EXAM_LETTERS)} AS letter, row_number() OVER (ORDER BY event_id) AS index FROM r),
        t AS (SELECT count(*) AS n, count(*) FILTER (letter = truth_letter) AS c, round_even(100.0 * count(*) FILTER (letter = truth_letter) / count(*), 2)::DOUBLE AS pct FROM l)
        SELECT 0 AS index, '{{"benchmark_name": "fixed benchmark", "model_name": "stand-in", "seed": 42, "total_questions": ' || n || ', "correct_count": ' || c
               || ', "accuracy_pct": ' || pct || ', "summary": {{"Accuracy": "' || printf('%.2f', pct) || '%", "Score": "' || c || '/' || n || '"}}, "per_question_results": [' AS line
        FROM t
        UNION ALL
        SELECT index, '{{"index":' || index || ',"event_id":' || event_id || ',"ground_truth_letter":"' || truth_letter || '","predicted_letter":"' || letter
               || '","is_correct":' || (letter = truth_letter) || ',"model_response":"' || response || '"}}' || CASE WHEN index < n THEN ',' ELSE '' END
        FROM l, t
        UNION ALL
        SELECT n + 1, ']}}' FROM t""",
    "sample_fixed": "SELECT item_id AS question_id FROM benchmark ORDER BY md5('42:' || item_id), item_id LIMIT 20",
    "benchmark_breakdown": f"""
        WITH {SAID},
        l AS (
            SELECT event_id, truth_letter, {_first("CASE WHEN event_id % 10 = 9 THEN '[ERROR: Generation failed: line ' || said || ']' ELSE response END", answers.EXAM_LETTERS)} AS letter
            FROM rs
        )
        SELECT row_number() OVER (ORDER BY event_id) AS index,
               '| ' || concat_ws(' | ', row_number() OVER (ORDER BY event_id), truth_letter, coalesce(nullif(letter, ''), 'None'),
                                 CASE WHEN letter = truth_letter THEN 'Passed' ELSE 'Failed' END) || ' |' AS line
        FROM l""",
    "report_documents": f"""
        WITH {ROWS}
        SELECT system_name, count(*) AS result_rows, 3 AS k, round_even(count(*) FILTER (is_right) / count(*), 6) AS accuracy_on_all_questions,
               {_CI_HIGH} AS ci_high, count(*) FILTER (NOT ok) AS failures_or_abstentions,
               round_even(count(*) FILTER (valid) / nullif(count(*) FILTER (ok), 0), 6) AS citation_valid_rate_on_successes, round_even(avg(nd), 6) AS ndcg_at_k,
               string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes,
               round_even(median(latency_ms) FILTER (scope = 'unannotated'), 3) AS median_latency_ms
        FROM x GROUP BY system_name""",
    "scope_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text || ' ', '') || [{", ".join(map(_text, PHRASES))}][doc_id % {len(PHRASES)} + 1] AS t FROM documents),
        m AS (SELECT doc_id, concat_ws(',', {_NAMED}) AS matched_terms FROM d)
        SELECT doc_id, matched_terms, CASE WHEN matched_terms <> '' THEN 'psychiatry_relevant' ELSE 'out_of_corpus' END AS scope,
               CASE WHEN matched_terms <> '' THEN 'psychiatry' ELSE 'general_medical' END AS topic, 'lexical_candidate' AS annotator
        FROM m""",
    "bm25_topk": f"WITH {BM25} SELECT question_id, chunk_id, rank, score FROM bm WHERE rank <= {K}",
    "bm25_index_stats": f"WITH {BM25} SELECT term, df, round(idf, 9) AS idf FROM idf",
    "topk_sweep": f"WITH {BM25}, ks AS (SELECT * FROM (VALUES {_KLIST}) t(k)) SELECT k, question_id, chunk_id, rank, score FROM bm, ks WHERE rank <= k",
    "dense_topk": f"""
        WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
        u AS (SELECT vec_id, i, x / CASE WHEN l > 0 THEN l ELSE 1 END AS x FROM v JOIN (SELECT vec_id, sqrt(sum(x * x)) AS l FROM v GROUP BY 1) USING (vec_id)),
        s AS (
            SELECT a.vec_id AS question_id, b.vec_id AS pos, round(sum(a.x * b.x), 9) AS score
            FROM u a JOIN u b USING (i) WHERE a.vec_id % 10 = 0 AND b.vec_id <> a.vec_id GROUP BY ALL
        )
        SELECT question_id, pos::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos)::INT AS rank, round(score, 6) AS score
        FROM s QUALIFY rank <= {K}""",
    "embedding_checks": """
        SELECT count(*) AS n, min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim,
               count(*) FILTER (embedding IS NULL OR len(embedding) = 0) AS n_empty,
               (SELECT count(DISTINCT vec_id) FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x IS NULL OR isnan(x)) AS n_odd
        FROM embeddings""",
    "hybrid_rrf": f"WITH {BM25}, {DENSE}, {FUSED} SELECT question_id, chunk_id, rank, score FROM fu WHERE k = {K}",
    "hybrid_sweep": f"WITH {BM25}, {DENSE}, {FUSED} SELECT k, question_id, chunk_id, rank, score FROM fu",
    "retrieval_metrics": f"""
        WITH {BM25}, {RANKED}
        SELECT count(*) AS labeled_queries, round_even(avg(h / ng), 6) AS recall_at_k, round_even(avg(h / {K}), 6) AS precision_at_k,
               round_even(avg(rr), 6) AS mrr, round_even(avg(dcg / ideal), 6) AS ndcg_at_k
        FROM m WHERE ng > 0""",
    "retrieval_metrics_strict": f"""
        WITH {BM25}, {RANKED}
        SELECT count(*) FILTER (ng > 0) AS labelled_queries, count(*) AS queries, round(avg(h / nullif(ng, 0)), 9) AS recall,
               round(avg(h / {K}) FILTER (ng > 0), 9) AS precision, round(avg(rr) FILTER (ng > 0), 9) AS mrr, round(avg(dcg / ideal), 9) AS ndcg
        FROM m""",
    "retrieval_map_mrr_f1": f"""
        WITH {BM25}, {RANKED},
        z AS (SELECT *, h / {K} AS p, coalesce(h / nullif(ng, 0), 0) AS r FROM m)
        SELECT round(avg(p), 9) AS precision, round(avg(r), 9) AS recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 9) AS f1,
               round(avg((h > 0)::INT), 9) AS hit, round(avg(coalesce(gains / nullif(least(ng, {K}), 0), 0)), 9) AS map, round(avg(rr), 9) AS mrr
        FROM z""",
    "run_report": f"""
        WITH {ROWS}
        SELECT system_name, scope, CASE WHEN grouping(scope) = 0 THEN 'scope' ELSE 'overall' END AS level, count(*) AS questions,
               count(*) FILTER (ok) AS evaluated_answers, count(*) FILTER (is_right) AS correct,
               round_even(count(*) FILTER (is_right) / count(*), 6) AS accuracy_on_all, {_CI_LOW} AS ci_low, {_CI_HIGH} AS ci_high,
               round_even(count(*) FILTER (is_right AND ok) / nullif(count(*) FILTER (ok), 0), 6) AS accuracy_on_successes,
               count(*) FILTER (NOT ok) AS failures, round_even(count(*) FILTER (NOT ok) / count(*), 6) AS failure_rate,
               count(*) FILTER (valid) AS citation_valid_successes,
               round_even(count(*) FILTER (valid) / nullif(count(*) FILTER (ok), 0), 6) AS citation_valid_rate,
               round_even(count(*) FILTER (has_cited) / count(*), 6) AS citation_coverage,
               round_even(avg(latency_ms), 3) AS mean_latency_ms, round_even(median(latency_ms), 3) AS median_latency_ms,
               round_even(avg(len(ids)), 3) AS mean_retrieved_chunks, count(recall) AS labeled_queries, round_even(avg(recall), 6) AS recall_at_k,
               round_even(avg(prec), 6) AS precision_at_k, round_even(avg(rr), 6) AS mrr, round_even(avg(nd), 6) AS ndcg_at_k
        FROM x GROUP BY GROUPING SETS ((system_name), (system_name, scope))""",
    "bm25_run_summary": f"""
        WITH {ROWS}
        SELECT scope, grouping(scope) = 0 AS by_scope, count(*) AS questions, count(*) FILTER (is_right) AS correct,
               round_even(count(*) FILTER (is_right) / count(*), 6) AS accuracy_on_all, count(*) FILTER (NOT ok) AS failures,
               round_even(count(*) FILTER (NOT ok) / count(*), 6) AS failure_rate,
               CASE WHEN grouping(scope) = 0 THEN count(*) FILTER (valid) END AS citation_valid_successes,
               CASE WHEN grouping(scope) = 0 THEN coalesce(round_even(count(*) FILTER (valid) / nullif(count(*) FILTER (ok), 0), 6), 0) END AS citation_valid_rate,
               round_even(avg(latency_ms), 3) AS mean_latency_ms, round_even(median(latency_ms), 3) AS median_latency_ms,
               CASE WHEN grouping(scope) = 1 THEN round_even(avg(len(ids)), 3) END AS mean_retrieved_chunks
        FROM x GROUP BY GROUPING SETS ((), (scope))""",
    "system_compare": f"""
        WITH {ROWS}
        SELECT CASE WHEN grouping(scope) = 0 THEN 'scope' ELSE 'overall' END AS level, scope, system_name, count(*) AS questions,
               count(*) FILTER (is_right) AS correct, round_even(count(*) FILTER (is_right) / count(*), 6) AS accuracy_on_all,
               {_CI_LOW} AS ci_low, {_CI_HIGH} AS ci_high, round_even(count(*) FILTER (NOT ok) / count(*), 6) AS failure_rate
        FROM x GROUP BY GROUPING SETS ((system_name), (system_name, scope))""",
    "accuracy_comparable": f"""
        WITH {ROWS}
        SELECT count(*) AS total, count(predicted_answer) AS evaluated, count(*) FILTER (predicted_answer = expected_answer) AS correct,
               count(*) FILTER (predicted_answer = expected_answer) / count(predicted_answer) AS accuracy FROM e""",
    "run_totals": f"WITH {ROWS} SELECT count(*) FILTER (is_right) AS correct, count(*) FILTER (NOT ok) AS failures FROM x",
    "fixed_benchmark_score": f"""
        WITH {SAID},
        c AS (
            SELECT 'exam' AS cascade, truth_letter, {_first("response", answers.EXAM_LETTERS)} AS letter FROM rs
            UNION ALL
            SELECT 'run', truth_letter, {_first("response", answers.RUN_LETTERS)} FROM rs
        )
        SELECT cascade, count(*) AS total_questions, count(*) FILTER (letter = truth_letter) AS correct_count,
               round_even(100.0 * count(*) FILTER (letter = truth_letter) / count(*), 2)::DOUBLE AS accuracy_pct,
               count(*) FILTER (letter = truth_letter) || '/' || count(*) AS score
        FROM c GROUP BY cascade""",
    "scope_annotate": f"""
        WITH {SCOPED}
        SELECT question_id, matched_terms, CASE WHEN matched_terms <> '' THEN 'psychiatry_relevant' ELSE 'out_of_corpus' END AS scope,
               matched_terms <> '' AS evidence_expected, CASE WHEN matched_terms <> '' THEN 'psychiatry' ELSE 'general_medical' END AS topic,
               'scope_v1' AS annotation_version
        FROM s""",
    "scope_counts": f"WITH {SCOPED} SELECT CASE WHEN matched_terms <> '' THEN 'psychiatry_relevant' ELSE 'out_of_corpus' END AS scope, count(*) AS n FROM s GROUP BY 1",
    "missing_annotations": f"""
        WITH s AS (SELECT item_id, {_rules("text")} AS matched_terms FROM benchmark)
        SELECT CASE WHEN item_id % 3 = 1 THEN NULL WHEN matched_terms <> '' THEN 'psychiatry_relevant' ELSE 'out_of_corpus' END AS scope, count(*) AS n,
               (SELECT count(*) FROM benchmark WHERE item_id % 3 = 1) AS n_missing
        FROM s GROUP BY 1""",
    "dataset_profile": """
        SELECT count(*) AS records, sum(length(text))::BIGINT AS characters, count(text) - count(DISTINCT text) AS duplicate_texts,
               count(DISTINCT source) AS unique_titles, min(CASE WHEN doc_id % 4 <> 0 THEN doc_id % 5 END)::INT AS min_index,
               max(CASE WHEN doc_id % 4 <> 0 THEN doc_id % 5 END)::INT AS max_index
        FROM documents""",
    "validate_records": """
        WITH a AS (
            SELECT p_partkey AS k, CASE WHEN k % 7 = 0 THEN 'dev-' || lpad(k::VARCHAR, 6, '0') WHEN k % 11 = 0 THEN 'same' ELSE 'p' || k END AS record_id,
                   CASE WHEN k % 17 = 0 THEN 0 WHEN k % 5 = 0 THEN 2 ELSE 3 END AS n,
                   CASE WHEN k % 17 = 0 THEN NULL WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 AND k % 4 < CASE WHEN k % 5 = 0 THEN 2 ELSE 3 END THEN k % 4 END AS i,
                   k % 3 <> 2 AS has_answer
            FROM part
        )
        SELECT k::BIGINT AS line, record_id, i::INT AS answer_index, CASE i WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS answer_letter,
               nullif(n, 0)::INT AS n_options,
               CASE WHEN k % 13 = 0 THEN 'question' WHEN n = 0 THEN 'options' WHEN has_answer AND i IS NULL THEN 'answer'
                    WHEN row_number() OVER (PARTITION BY record_id ORDER BY k) > 1 THEN 'duplicate id' END AS reject
        FROM a""",
    "chunk_windows": """
        WITH a AS (SELECT doc_id, text, unnest(range(greatest(0, ceil((length(text) - 512) / 448))::BIGINT + 1)) AS w FROM documents WHERE length(text) > 0)
        SELECT doc_id, w::INT AS "window", length(substring(text, w * 448 + 1, 512))::INT AS n_chars, md5(substring(text, w * 448 + 1, 512)) AS digest FROM a""",
    "text_overlap": f"""
        WITH c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations),
        a AS (SELECT text AS answer, question, {_WSWORDS.format("text")} AS p, {_WSWORDS.format("question")} AS t FROM c WHERE role = 'assistant' AND question IS NOT NULL),
        f AS (SELECT *, len(list_distinct(list_intersect(p, t))) AS common FROM a)
        SELECT count(*) AS n, round(avg((lower(trim(answer)) = lower(trim(question)))::INT), 9) AS exact_match,
               round(avg(CASE WHEN common > 0 THEN 2 * (common / len(p)) * (common / len(t)) / (common / len(p) + common / len(t)) ELSE 0 END), 9) AS f1_score
        FROM f""",
    "first_questions": "SELECT item_id AS question_id FROM benchmark ORDER BY item_id LIMIT 10",
    "tokens_profile": f"""
        WITH s AS (SELECT doc_id, count(*) FILTER (trim(s) <> '') AS n FROM (SELECT doc_id, unnest({_SENTENCES.format("text")}) AS s FROM documents) GROUP BY 1)
        SELECT doc_id, len({TERMS.format("text")})::INT AS n_terms, len({_WSWORDS.format("text")})::INT AS n_words, s.n::INT AS n_sentences,
               regexp_replace(lang || '/ ' || source, '[^\\w.-]', '_', 'g') AS name
        FROM documents JOIN s USING (doc_id)""",
}
ORACLES["dense_pruned_topk"] = ORACLES["dense_topk"]
