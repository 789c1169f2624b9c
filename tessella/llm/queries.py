"""The queries of this subpackage: one for each operator, by name."""

from __future__ import annotations

from tessella.llm.chosen_path import op8_ngram_jaccard_join
from tessella.llm.fingerprints import op6_fingerprints
from tessella.llm.html_text import op7_html_text
from tessella.llm.mixing import op10_mixing
from tessella.llm.packing import op5_packing
from tessella.llm.substring_dedup import op1_suffix_dedup
from tessella.llm.token_counts import op9_token_counts
from tessella.llm.token_files import op4_token_ids
from tessella.llm.topk import op2_topk_search
from tessella.llm.toxicity import op3_toxicity

QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_topk_search": op2_topk_search, "op3_toxicity": op3_toxicity, "op4_token_ids": op4_token_ids, "op5_packing": op5_packing, "op6_fingerprints": op6_fingerprints, "op7_html_text": op7_html_text, "op8_ngram_jaccard_join": op8_ngram_jaccard_join, "op9_token_counts": op9_token_counts, "op10_mixing": op10_mixing}
#: Of the others none can be stated in SQL: they go by a tokenizer, a trained model, hashed draws or byte strings by the million.
SQL: dict[str, str] = {
    "op2_topk_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id))::INT AS rank, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20""",
    "op8_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [array_to_string(ws, ' ')] END) AS gram FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS grams FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT d.doc_id AS doc_id, c.class_id AS class_id, coalesce(k.copy_id, d.doc_id) AS copy_id, coalesce(m.n_links, 0) AS n_links FROM documents d JOIN (SELECT a, min(b) AS class_id FROM r GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY grams) AS copy_id FROM n) k ON k.doc_id = d.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM u GROUP BY a) m ON m.a = d.doc_id""",
}
