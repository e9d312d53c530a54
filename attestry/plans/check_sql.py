"""The derived tables once more, as SQL for the independent check engine.

``compose`` puts the common table expressions a query names, and those they
need in turn, in front of it.
"""

from __future__ import annotations

import re


def grams(text: str) -> str:
    """Distinct padded 3-grams of a text expression."""
    return (
        "list_distinct(flatten(list_transform(regexp_extract_all(lower(" + text + r"), '[\p{L}\p{N}]+'), "
        "lambda w: list_transform(range(1, length(w)+2), lambda i: substr('  '||w||' ', i, 3)))))"
    )


def similarity(a: str, b: str) -> str:
    """Jaccard of two gram lists."""
    return (
        f"(case when len({a})+len({b})=0 then 0.0::double else "
        f"len(list_intersect({a},{b}))::double/(len({a})+len({b})-len(list_intersect({a},{b}))) end)"
    )


def slug(text: str) -> str:
    return (
        f"coalesce(nullif(trim(regexp_replace(lower({text}),'[^a-z0-9]+','-','g'),'-'),''),'unknown')"
    )


def uuid5(name: str, namespace: str = "8f2f6b1a2c3d4e5f9a1b6c7d8e9f0a1b") -> str:
    h = f"sha1(unhex('{namespace}') || encode({name}))"
    return (
        f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||"
        f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)||'-'||substr({h},21,12))"
    )


def _winners(rows: str) -> str:
    """Winning claims per feature field, ``place`` 1 first; every distinct risk is its own slot."""
    return f"""
  SELECT *, row_number() OVER (PARTITION BY corpus_id, feature_key, field, slot
    ORDER BY confidence DESC, coalesce(ingested_at, TIMESTAMP '0001-01-01') DESC, claim_id) AS place
  FROM (SELECT corpus_id, feature_key, 'name' AS field, '' AS slot, subject AS value, claim_id, confidence, ingested_at FROM ({rows})
    UNION ALL SELECT corpus_id, feature_key, predicate, '', object, claim_id, confidence, ingested_at FROM ({rows}) WHERE predicate IN ('owner', 'target_release', 'status')
    UNION ALL SELECT corpus_id, feature_key, 'open_risks', object, object, claim_id, confidence, ingested_at FROM ({rows}) WHERE predicate = 'risk')"""


def _fields(won: str) -> str:
    single = ", ".join(
        f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in ["name", "owner", "target_release", "status"]
    )
    return f"""
  SELECT corpus_id, feature_key, {single},
    coalesce(list(value ORDER BY confidence DESC, coalesce(ingested_at, TIMESTAMP '0001-01-01') DESC, claim_id) FILTER (WHERE field = 'open_risks'), []) AS open_risks
  FROM {won} GROUP BY corpus_id, feature_key"""


VIEWS = {
    "docs": r"""
  SELECT doc_id, source AS corpus_id, 'doc_' || doc_id || '.md' AS filename, lang,
    CASE WHEN doc_id % 10 = 0 THEN '# ' || replace(text, chr(10), chr(10) || '# ')
         WHEN doc_id % 5 = 0 THEN '# Part' || chr(10) || text ELSE text END AS text,
    CASE WHEN doc_id % 19 <> 0 THEN
      (['prd','techspec','ticket_export','meeting_notes','release_notes','postmortem','other'])[doc_id % 7 + 1] END AS doc_type,
    CASE WHEN doc_id % 23 <> 0 THEN make_timestamp(1704067200000000 + doc_id * 60000000) END AS ingested_at,
    CASE WHEN (doc_id // 20) % 5 = 4 THEN source || ':update-' || (doc_id // 1000) ELSE source || ':initial' END AS run_id
  FROM documents""",
    "pieces": r"""
  SELECT doc_id, corpus_id, run_id, lang, text,
    string_split(regexp_replace(text, '(?m)^#\s+\S.*$', chr(1) || '\0', 'g'), chr(1)) AS parts FROM docs""",
    "heads": r"""
  SELECT doc_id, corpus_id, run_id, lang, unnest(kept) AS part, generate_subscripts(kept, 1) - 1 AS seg FROM (
    SELECT *, CASE WHEN len(parts) > 1 AND parts[1] = '' THEN parts[2:] ELSE parts END AS kept FROM pieces)""",
    "segs": r"""
  SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seg_start FROM heads""",
    "chunks": r"""
  SELECT doc_id, corpus_id, run_id, lang, k AS win,
    (row_number() OVER (PARTITION BY doc_id ORDER BY seg, k) - 1)::INTEGER AS idx,
    doc_id * 1000000 + (row_number() OVER (PARTITION BY doc_id ORDER BY seg, k) - 1) AS chunk_id,
    seg_start + k * 800 AS char_start, least(seg_start + k * 800 + 1000, seg_start + length(part)) AS char_end,
    substr(part, (k * 800 + 1)::BIGINT, 1000) AS text
  FROM (SELECT *, unnest(range(0, CASE WHEN length(part) = 0 THEN 0 WHEN length(part) <= 1000 THEN 1
      ELSE ceil((length(part) - 1000) / 800.0)::BIGINT + 1 END)) AS k FROM segs)""",
    "runs": r"""
  SELECT run_id, corpus_id, CASE WHEN run_id LIKE '%:initial' THEN 'initial' ELSE 'update' END AS kind,
    CASE WHEN run_id LIKE '%:initial' THEN NULL ELSE max(doc_id) END AS triggering_document_id,
    make_timestamp(1704067200000000 + min(doc_id) * 60000000) AS started_at
  FROM docs GROUP BY run_id, corpus_id""",
    "candidates": r"""
  SELECT chunk_id AS claim_id, run_id, corpus_id, doc_id, idx, win, chunk_id,
    CASE WHEN doc_id % 3 = 0 THEN lower('Feature ' || upper(lang) || ' ' || ((doc_id // 100) % 4) || '/' || (doc_id // 1000))
      ELSE 'Feature ' || upper(lang) || ' ' || ((doc_id // 100) % 4) || '.' || (doc_id // 1000) END AS subject,
    (['owner','target_release','status','risk','note'])[(doc_id + idx) % 5 + 1] AS predicate,
    'v' || ((doc_id * 7 + idx * 3) % 4) AS object,
    (((doc_id * 13 + idx * 5) % 10) / 10.0)::FLOAT AS confidence,
    substr(text, 5, 30) || CASE WHEN (doc_id + idx) % 11 = 0 THEN '~~' ELSE '' END AS quote
  FROM chunks""",
    "candidate_sources": r"""
  SELECT claim_id, 0 AS pos, doc_id, CASE WHEN (doc_id + idx) % 13 = 0 THEN (doc_id + 1) * 1000000 ELSE chunk_id END AS chunk_id, quote
  FROM candidates WHERE (doc_id + idx) % 17 <> 0
  UNION ALL SELECT claim_id, 1, doc_id, chunk_id - 1, quote FROM candidates
  WHERE (doc_id + idx) % 17 <> 0 AND (doc_id + idx) % 4 = 0 AND win > 0""",
    # every source must name a chunk of the same document that holds the quote
    "verdicts": r"""
  SELECT c.claim_id, bool_and(k.chunk_id IS NOT NULL AND contains(k.text, s.quote)) AS ok
  FROM candidates c JOIN candidate_sources s USING (claim_id)
  LEFT JOIN chunks k ON k.chunk_id = s.chunk_id AND k.doc_id = c.doc_id GROUP BY c.claim_id""",
    "claims": r"""
  SELECT claim_id, run_id, corpus_id, subject, predicate, object, confidence FROM candidates JOIN verdicts USING (claim_id) WHERE ok""",
    "claim_sources": r"""
  SELECT claim_id, chunk_id, quote FROM candidate_sources JOIN verdicts USING (claim_id) WHERE ok""",
    # claims with the slug of their subject and the newest time of their documents
    "rowsv": rf"""
  SELECT c.*, {slug("c.subject")} AS feature_key, t.ingested_at FROM claims c JOIN (
    SELECT s.claim_id, max(d.ingested_at) AS ingested_at FROM claim_sources s JOIN chunks k USING (chunk_id) JOIN docs d ON d.doc_id = k.doc_id GROUP BY 1) t USING (claim_id)""",
    "ranked_all": _winners("SELECT * FROM rowsv"),
    "ranked_init": _winners("SELECT * FROM rowsv WHERE run_id LIKE '%:initial'"),
    "won_all": "SELECT * FROM ranked_all WHERE place = 1",
    "won_init": "SELECT * FROM ranked_init WHERE place = 1",
    "fields_all": _fields("won_all"),
    "fields_init": _fields("won_init"),
    "entries": rf"""
  SELECT {uuid5("'entry:' || corpus_id || ':' || feature_key")} AS entry_id, *, 1 AS version, corpus_id || ':initial' AS last_updated_run_id FROM fields_init""",
    "field_sources": r"""
  SELECT entry_id, field, claim_id FROM entries JOIN won_init USING (corpus_id, feature_key)""",
    "affected": rf"""
  SELECT DISTINCT run_id, corpus_id, {slug("subject")} AS feature_key FROM claims WHERE run_id NOT LIKE '%:initial'""",
    "additions": rf"""
  SELECT {uuid5("a.run_id || ':' || a.feature_key")} AS item_id, a.run_id, f.* FROM affected a JOIN fields_all f USING (corpus_id, feature_key)
  WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.corpus_id = a.corpus_id AND e.feature_key = a.feature_key)""",
    "backing": r"""
  SELECT corpus_id, feature_key, field, list(DISTINCT claim_id) AS ids FROM field_sources JOIN entries USING (entry_id) GROUP BY 1, 2, 3""",
    "changed": r"""
  SELECT w.corpus_id, w.feature_key, w.field, min(w.claim_id::VARCHAR)::BIGINT AS claim_id
  FROM won_all w JOIN entries e USING (corpus_id, feature_key)
  LEFT JOIN backing b ON b.corpus_id = w.corpus_id AND b.feature_key = w.feature_key AND b.field = w.field
  WHERE CASE WHEN w.field = 'open_risks' THEN NOT coalesce(list_contains(b.ids, w.claim_id), false)
             ELSE NOT coalesce(len(b.ids) = 1 AND b.ids[1] = w.claim_id, false) END
  GROUP BY 1, 2, 3""",
    "changes": rf"""
  SELECT {uuid5("a.run_id || ':' || a.feature_key || ':' || c.field")} AS item_id, a.run_id, c.*, e.entry_id,
    CASE c.field WHEN 'name' THEN e.name WHEN 'owner' THEN e.owner WHEN 'target_release' THEN e.target_release WHEN 'status' THEN e.status ELSE array_to_string(e.open_risks, '|') END AS old_value,
    CASE c.field WHEN 'name' THEN f.name WHEN 'owner' THEN f.owner WHEN 'target_release' THEN f.target_release WHEN 'status' THEN f.status ELSE array_to_string(f.open_risks, '|') END AS new_value
  FROM changed c JOIN affected a USING (corpus_id, feature_key) JOIN entries e USING (corpus_id, feature_key) JOIN fields_all f USING (corpus_id, feature_key)""",
    "unaffected": r"""
  SELECT a.*, e.entry_id FROM affected a JOIN entries e USING (corpus_id, feature_key)
  WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.run_id = a.run_id AND c.corpus_id = a.corpus_id AND c.feature_key = a.feature_key)""",
    "conflicts": rf"""
  SELECT {uuid5("'conflict:' || a.claim_id || ':' || b.claim_id")} AS conflict_id, a.run_id, a.subject, a.predicate, a.claim_id AS claim_a_id, b.claim_id AS claim_b_id
  FROM claims a JOIN claims b ON a.run_id = b.run_id AND a.subject = b.subject AND a.predicate = b.predicate AND a.claim_id < b.claim_id AND a.object <> b.object""",
    "doc_types": r"""
  SELECT s.claim_id, d.doc_type FROM claim_sources s JOIN chunks k USING (chunk_id) JOIN docs d ON d.doc_id = k.doc_id WHERE d.doc_type IS NOT NULL""",
    "violations": r"""
  SELECT run_id, subject, 'every_feature_has_owner' AS rule_id, 'warning' AS severity, '''' || subject || ''' has no claim for predicate ''owner''' AS message FROM claims GROUP BY run_id, subject HAVING NOT bool_or(predicate = 'owner')
  UNION ALL SELECT run_id, subject, 'every_feature_has_target_release', 'warning', '''' || subject || ''' has no claim for predicate ''target_release''' FROM claims GROUP BY run_id, subject HAVING NOT bool_or(predicate = 'target_release')
  UNION ALL SELECT run_id, subject, 'no_status_v1', 'error', '''' || subject || ''' has status=''v1'', which rule ''no_status_v1'' forbids' FROM claims GROUP BY run_id, subject HAVING bool_or(predicate = 'status' AND object = 'v1')
  UNION ALL SELECT r.run_id, NULL, 'some_risk', 'info', 'no claim with predicate ''risk'' found' FROM runs r WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.run_id = r.run_id AND c.predicate = 'risk')
  UNION ALL SELECT run_id, subject, 'shipped_requires_release_notes', 'error', 'rule ''shipped_requires_release_notes'' failed for ''' || subject || ''''
    FROM claims c LEFT JOIN (SELECT DISTINCT claim_id FROM doc_types WHERE doc_type = 'release_notes') t USING (claim_id)
    GROUP BY run_id, subject HAVING bool_or(predicate = 'status' AND object = 'v2') AND count(t.claim_id) = 0""",
    "findings": rf"""
  SELECT {uuid5("'finding:' || run_id || ':' || rule_id || ':' || coalesce(subject, '')")} AS finding_id, * FROM violations""",
    "finding_sources": r"""
  SELECT f.finding_id, c.claim_id FROM findings f JOIN claims c ON c.run_id = f.run_id AND c.subject = f.subject
  WHERE f.rule_id <> 'no_status_v1' OR (c.predicate = 'status' AND c.object = 'v1')""",
    "audit": r"""
  SELECT event_id AS id, user_id AS run_id, ts AS occurred_at, props AS payload,
    CASE WHEN event_id % 97 = 0 THEN 'run_completed' ELSE
    CASE event_type WHEN 'view' THEN 'classify' WHEN 'click' THEN 'extract' WHEN 'signup' THEN 'detect_conflicts'
      WHEN 'purchase' THEN 'examine' ELSE 'register_entry_proposed' END ||
    CASE WHEN event_type = 'error' THEN '' WHEN event_id % 2 = 0 THEN '_start' ELSE '_end' END END AS event_type
  FROM events""",
    "costs": r"""
  SELECT event_id AS id, user_id AS run_id,
    CASE event_type WHEN 'view' THEN 'classify' WHEN 'click' THEN 'extract' WHEN 'signup' THEN 'examine' ELSE 'embed' END AS stage,
    CASE WHEN event_id % 3 = 0 THEN 'unlisted-model' ELSE 'default-model' END AS model,
    floor(value * 10)::BIGINT AS input_tokens, event_id % 500 AS output_tokens, event_id % 1000 AS latency_ms, ts AS occurred_at
  FROM events WHERE event_type <> 'error'""",
}


def compose(query: str) -> str:
    """``query`` with the views it uses as a WITH clause."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"(?i)\b(?:from|join)\s+{name}\b", sql) and name not in needed:
                visit(body)
                needed.append(name)

    visit(query)
    if not needed:
        return query
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    own = re.match(r"(?is)\s*with\s+(.*)", query)
    return f"WITH {head},\n{own.group(1)}" if own else f"WITH {head}\n{query}"


# Decisions taken from the labels of the document behind an item.
_DECISION = "CASE WHEN l.quality = 1 THEN 'approve' ELSE 'reject' END"
VIEWS |= {
    "conflict_calls": f"""
  SELECT c.conflict_id AS item_id, c.run_id, 'conflict' AS item_type, {_DECISION} AS decision, 'reviewer-' || l.toxic AS reviewer
  FROM conflicts c JOIN labels l ON l.doc_id = c.claim_a_id // 1000000""",
    "finding_calls": f"""
  SELECT f.finding_id AS item_id, f.run_id, 'finding' AS item_type, {_DECISION} AS decision, 'reviewer-' || l.toxic AS reviewer
  FROM findings f JOIN (SELECT finding_id, min(claim_id) AS claim_id FROM finding_sources GROUP BY 1) s USING (finding_id) JOIN labels l ON l.doc_id = s.claim_id // 1000000""",
    "change_calls": f"""
  SELECT i.item_id, i.run_id, 'register_change' AS item_type, {_DECISION} AS decision, 'reviewer-' || l.toxic AS reviewer
  FROM (SELECT a.item_id, a.run_id, w.claim_id FROM additions a JOIN won_all w USING (corpus_id, feature_key) WHERE w.field = 'name'
        UNION ALL SELECT item_id, run_id, claim_id FROM changes) i JOIN labels l ON l.doc_id = i.claim_id // 1000000""",
    "addition_state": """
  SELECT a.*, CASE c.decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS state
  FROM additions a LEFT JOIN change_calls c USING (item_id)""",
    "change_state": """
  SELECT a.*, CASE c.decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS state
  FROM changes a LEFT JOIN change_calls c USING (item_id)""",
    "finding_cites": """
  SELECT finding_id, claim_id, NULL::BIGINT AS chunk_id FROM finding_sources
  UNION ALL SELECT f.finding_id, NULL, k.chunk_id FROM findings f JOIN (SELECT run_id, min(chunk_id) AS chunk_id FROM chunks GROUP BY 1) k USING (run_id) WHERE f.subject IS NULL""",
    "spots": """
  SELECT s.claim_id, s.chunk_id, s.quote, k.doc_id, k.char_start, k.char_end, k.text, strpos(k.text, s.quote) - 1 AS found FROM claim_sources s JOIN chunks k USING (chunk_id)""",
    "cited": """
  SELECT claim_id, chunk_id, quote, doc_id, char_start, char_end, 'doc_' || doc_id || '.md' AS document_filename,
    substr(text, lo + 1, hi - lo) AS snippet, (greatest(found, 0) - lo)::INTEGER AS highlight_start, (greatest(found, 0) - lo + width)::INTEGER AS highlight_end
  FROM (SELECT *, least(length(text), greatest(found, 0) + width + 80) AS hi FROM (
    SELECT *, CASE WHEN found >= 0 THEN length(quote) ELSE 0 END AS width, greatest(greatest(found, 0) - 80, 0) AS lo FROM spots))""",
    "evruns": """
  SELECT user_id AS run_id, min(ts) AS started_at, 'src' || (user_id % 20) AS corpus_id FROM events GROUP BY user_id""",
    "corpora": """
  SELECT source AS corpus_id, 'Corpus ' || substr(source, 4) AS name, '/inbox/' || (substr(source, 4)::INTEGER % 6) AS inbox_path,
    make_timestamp(1704067200000000 + min(doc_id) * 60000000) AS created_at FROM documents WHERE substr(source, 4)::INTEGER % 7 <> 3 GROUP BY source""",
    "priced": """
  SELECT *, (input_tokens * 3 + output_tokens * 15)::BIGINT AS micro_usd FROM costs""",
}

_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def cosine(a: str, b: str) -> str:
    ab, aa, bb = _DOT.format(a=a, b=b), _DOT.format(a=a, b=a), _DOT.format(a=b, b=b)
    return f"(1.0 - {ab} / (sqrt({aa}) * sqrt({bb})))"


def _vector_list(queries: str) -> str:
    return f"""
  SELECT * FROM (SELECT q.query_id, k.chunk_id, {cosine("k.embedding", "q.vector")} AS distance,
    row_number() OVER (PARTITION BY q.query_id ORDER BY {cosine("k.embedding", "q.vector")}, k.chunk_id) AS rank
  FROM chunk_vectors k JOIN {queries} q USING (corpus_id) WHERE k.embedding IS NOT NULL AND q.vector IS NOT NULL) WHERE rank <= 40"""


def _trigram_list(queries: str) -> str:
    return f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, k.chunk_id, {similarity("k.g", "q.g")} AS similarity FROM chunk_grams k JOIN (SELECT query_id, corpus_id, {grams("query")} AS g FROM {queries}) q USING (corpus_id))) WHERE rank <= 40"""


def _fused(vectors: str, trigrams: str) -> str:
    return f"""
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank_0 NULLS LAST, rank_1 NULLS LAST) AS fused_rank FROM (
    SELECT query_id, chunk_id, v.rank AS rank_0, t.rank AS rank_1, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS score
    FROM {vectors} v FULL JOIN {trigrams} t USING (query_id, chunk_id))"""


VIEWS |= {
    "chunk_vectors": """
  SELECT k.*, CASE WHEN e.vec_id % 9 <> 0 THEN e.embedding END AS embedding FROM chunks k LEFT JOIN embeddings e ON e.vec_id = k.doc_id + k.idx""",
    "chunk_grams": f"SELECT chunk_id, doc_id, idx, corpus_id, {grams('text')} AS g FROM chunks",
    "bench_q": """
  SELECT item_id AS query_id, text AS query, 'src' || (item_id % 20) AS corpus_id, e.embedding AS vector FROM benchmark LEFT JOIN embeddings e ON e.vec_id = item_id""",
    "talk_q": """
  SELECT conv_id * 1000 + turn AS query_id, text AS query, 'src' || (conv_id % 20) AS corpus_id, e.embedding AS vector
  FROM conversations LEFT JOIN embeddings e ON e.vec_id = conv_id + turn""",
    "bench_v": _vector_list("bench_q"),
    "bench_t": _trigram_list("bench_q"),
    "bench_f": _fused("bench_v", "bench_t"),
    "talk_v": _vector_list("talk_q"),
    "talk_t": _trigram_list("talk_q"),
    "talk_f": _fused("talk_v", "talk_t"),
    "triggers": "SELECT run_id, corpus_id, triggering_document_id AS doc_id FROM runs WHERE kind = 'update'",
    "neighbors": f"""
  SELECT run_id, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seed, rank) AS position FROM (
    SELECT run_id, doc_id, min(seed) AS seed, arg_min(rank, (seed, rank)) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, seed ORDER BY similarity DESC, chunk_id) AS rank FROM (
        SELECT t.run_id, s.idx AS seed, k.doc_id, k.chunk_id, {similarity("k.g", "s.g")} AS similarity
        FROM triggers t JOIN chunk_grams s ON s.doc_id = t.doc_id AND s.idx < 3 JOIN chunk_grams k ON k.corpus_id = t.corpus_id AND k.doc_id <> t.doc_id)
      WHERE similarity >= 0.15) WHERE rank <= 5 GROUP BY run_id, doc_id)) WHERE position <= 3""",
}
