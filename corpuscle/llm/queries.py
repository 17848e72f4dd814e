"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op6_bpe_transducer
from .fingerprints import op1_document_fingerprints
from .ngram_join import op3_ngram_jaccard_join
from .packing import op5_harmonic_packing
from .quality import op8_quality_rules
from .seekable import op10_seekable_token_files
from .sharding import op2_two_pass_sharding
from .substring import op9_substring_fm_index
from .token_counts import op4_unigram_token_counts
from .toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_two_pass_sharding,
        op3_ngram_jaccard_join,
        op4_unigram_token_counts,
        op5_harmonic_packing,
        op6_bpe_transducer,
        op7_toxicity,
        op8_quality_rules,
        op9_substring_fm_index,
        op10_seekable_token_files,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: SQL of the operators that SQL can express; tests/llm holds the others against brute force
ORACLE: dict[str, str] = {
    "op3_ngram_jaccard_join": rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
t AS (SELECT r, r AS o FROM d UNION SELECT t.r, l.y FROM t JOIN l ON t.o = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id FROM d LEFT JOIN n ON n.r = d.r JOIN t ON t.r = d.r JOIN d e ON e.r = t.o GROUP BY d.r, d.doc_id""",
    "op9_substring_fm_index": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
m AS (SELECT g FROM x GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM x SEMI JOIN m USING (g), range(35) t(k)),
word AS (SELECT r, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(v, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY 1),
lost AS (SELECT r, count(*) AS k FROM gone GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(lost.k, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)""",
}
