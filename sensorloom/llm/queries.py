"""The queries of this subpackage for the driver, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact, lattice, merkle, middle, mixing, near, packing, pii, quality, topk, warc
from .common import crc_mod, table

WORD_BPE = "word_bpe_49k.json"
#: Wanted shares of tokens by language.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
PIECES = "piece_bpe_32k.model"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.token_counts(docs, public_tokenizers.path(WORD_BPE))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("payload")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the manifest is of the table as it is; every fifth row is checked with its text in small letters
    text = F.col("text")
    small = F.when(crc_mod("doc_id", 5) == 0, F.translate(text, decontaminate.CAPITALS, decontaminate.SMALL)).otherwise(text)
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), now={"text": small}))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored(), 256).alias("restored_sha256"))


def merkle_sql(fanout: int = 16, levels: int = 4, above: int = 3) -> str:
    """The manifest with its levels written out: ``fanout`` to the power of ``levels`` rows of a source, and of ``above`` sources, at most."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    h = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    step = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, (a & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {step}), 4294967295)"
    sql = f"""WITH d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small, {crc} % 5 = 0 AS changed FROM documents),
        l AS (SELECT doc_id, source, coalesce('s' || source, '') AS g, {h("text")} AS leaf, CASE WHEN changed THEN {h("small")} ELSE {h("text")} END AS now FROM d),
        d0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l), a0 AS (SELECT g, pos AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM d0)"""
    names = []
    for base, count, key in (("a", levels, "g, "), ("b", above, "")):
        group = "g" if base == "a" else "1"
        if base == "b":
            sql += f", b0 AS (SELECT 's' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS source_key FROM (SELECT g, h FROM a{levels} WHERE n = 1))"
        for k in range(count):
            over = f"{base}{k}"
            sql += f", {base}{k + 1} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, i, h FROM {over} WHERE n = 1 UNION ALL SELECT g, i // {fanout}, sha256(string_agg(h, '' ORDER BY i)) FROM {over} WHERE n > 1 GROUP BY g, i // {fanout}))"
            w = f"OVER (PARTITION BY g, i // {fanout} ORDER BY i ROWS BETWEEN"
            sql += f", {base}s{k} AS (SELECT g, i, n, coalesce(string_agg(h, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo, coalesce(string_agg(h, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM {over})"
            names.append((base, k, group, key))
    sql += ", f0 AS (SELECT d0.*, b0.i AS place, b0.h AS subroot, '' AS way, now AS h FROM d0 JOIN b0 ON d0.g = b0.source_key)"
    for n, (base, k, _, _) in enumerate(names):
        on = f"f.g = s.g AND f.pos // {fanout**k} = s.i" if base == "a" else f"s.i = f.place // {fanout**k}"
        sql += f", f{n + 1} AS (SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN f.way || s.lo || s.hi ELSE f.way END AS way, CASE WHEN s.n > 1 THEN sha256(s.lo || f.h || s.hi) ELSE f.h END AS h) FROM f{n} f JOIN {base}s{k} s ON {on})"
    return f"{sql} SELECT doc_id, leaf, subroot, r.h AS root, sha256(way) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified FROM f{len(names)} f, (SELECT h FROM b{above}) r"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_quality, op2_lattice_scores, op3_token_counts, op4_mixing, op5_near_dedup, op6_warc, op7_pii, op8_packing, op9_exact_dedup, op10_exact_topk, op11_merkle_manifest, op12_decontaminate, op13_fill_in_middle)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
            FROM f""",
        "op9_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY text)""",
        "op10_exact_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op11_merkle_manifest": merkle_sql(),
        "op12_decontaminate": r"""
            WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
            bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
            it AS (SELECT item, least(len(w), 10) AS l, unnest(list_transform(range(len(w) - least(len(w), 10) + 1), lambda s: array_to_string(w[s + 1 : s + 10], ' '))) AS win FROM bw WHERE len(w) > 0),
            pl AS (SELECT r, l, list_transform(range(greatest(len(w) - l + 1, 0)), lambda s: array_to_string(w[s + 1 : s + l], ' ')) AS wins FROM dw, (SELECT DISTINCT l FROM it)),
            pp AS (SELECT r, l, unnest(wins) AS win, unnest(range(len(wins))) AS s FROM pl),
            h AS (SELECT DISTINCT r, s, l, win FROM pp SEMI JOIN it USING (win, l)),
            n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS p FROM h) GROUP BY r),
            i AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM h JOIN it USING (win, l)) GROUP BY r)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
            FROM dw LEFT JOIN n USING (r) LEFT JOIN i USING (r)""",
        "op13_fill_in_middle": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
            u AS (SELECT *, string_split(t, chr(10)) AS p, length(t) - length(replace(t, chr(10), '')) AS breaks,
                         list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS r FROM d),
            n AS (SELECT *, breaks + CASE WHEN t = '' OR ends_with(t, chr(10)) THEN 0 ELSE 1 END AS n FROM u),
            k AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS z,
                         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
            c AS (SELECT *, CASE WHEN a = 0 THEN '' WHEN a > breaks THEN t ELSE array_to_string(p[1:a], chr(10)) || chr(10) END AS pre,
                         CASE WHEN z = 0 THEN '' WHEN z > breaks THEN t ELSE array_to_string(p[1:z], chr(10)) || chr(10) END AS upto FROM k),
            m AS (SELECT *, substr(upto, length(pre) + 1) AS mid, substr(t, length(upto) + 1) AS suf FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
                   sha256(t) AS restored_sha256 FROM m""",
    }
