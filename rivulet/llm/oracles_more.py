"""SQL that returns the rows of operators 11 to 13."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of a decimal number: a table of 256 entries by its rule, then one step for each digit.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


def _merkle(levels: int = 5, tops: int = 3) -> str:
    """Trees of up to 16 ** levels leaves a source and 16 ** tops sources."""
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    of = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    sql = [
        f"c AS MATERIALIZED (SELECT {CRC_TABLE} AS crc_table)",
        f"d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {of('text')} AS leaf, CASE WHEN {CRC.format('doc_id')} % 5 = 0 THEN {of(LOWER.format('text'))} ELSE {of('text')} END AS found FROM documents, c)",
        "a0 AS MATERIALIZED (SELECT *, leaf AS d, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d)",
    ]

    def up(name: str, most: int) -> None:
        for k in range(1, most + 1):
            sql.append(f"{name}{k} AS MATERIALIZED (SELECT g, n, i // 16 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}{k - 1} WHERE n > {16 ** (k - 1)} GROUP BY g, n, i // 16)")
        for k in range(most):
            sql.append(f"{name}kids{k} AS (SELECT g AS kg, i // 16 AS kp, list(d ORDER BY i) AS kids FROM {name}{k} WHERE n > {16**k} GROUP BY g, i // 16)")

    up("a", levels)
    subroots = " UNION ALL ".join(f"SELECT g, d FROM a{k} WHERE n <= {16**k}" + (f" AND n > {16 ** (k - 1)}" if k else "") for k in range(levels + 1))
    sql += [f"sub AS MATERIALIZED ({subroots})", "b0 AS MATERIALIZED (SELECT 0 AS g, g AS i, d, count(*) OVER () AS n FROM sub)"]
    up("b", tops)
    root = " UNION ALL ".join(f"SELECT d FROM b{k} WHERE n <= {16**k}" + (f" AND n > {16 ** (k - 1)}" if k else "") for k in range(tops + 1))
    sql.append("p AS (SELECT a0.doc_id, a0.leaf, a0.found, a0.i, a0.g, sub.d AS subroot, r.d AS root FROM a0 JOIN sub USING (g), (" + root + ") r)")
    at, fold, proof, rest = "p", "found", "''", ""
    for name, place, most in (("a", "i", levels), ("b", "g", tops)):
        for k in range(most):
            own = f"({place} // {16**k} % 16)"
            on = f"kp = {place} // {16 ** (k + 1)}" + (" AND kg = g" if name == "a" else "")
            left, right = f"array_to_string(kids[1:{own}], '')", f"array_to_string(kids[{own} + 2:], '')"
            folded = f"CASE WHEN kp IS NULL THEN {fold} ELSE sha256({left} || {fold} || {right}) END AS fold"
            proved = f"{proof} || CASE WHEN kp IS NULL THEN '' ELSE {left} || {right} END AS proof"
            sql.append(f"{name}path{k} AS (SELECT {at}.*{rest}, {folded}, {proved} FROM {at} LEFT JOIN {name}kids{k} ON {on})")
            at, fold, proof, rest = f"{name}path{k}", "fold", "proof", " EXCLUDE (fold, proof)"
    return "WITH " + ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM {at}"


MERKLE = _merkle()

TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {TERMS.format("text")} AS w FROM documents),
s AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
q AS MATERIALIZED (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest({TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
t AS MATERIALIZED (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, big_n),
p AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l))))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM p WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 10
"""

# base32 of the 40 hexadecimal digits of a digest, 5 of them (20 bits) at a time
BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {15 - 5 * j} & 31 AS INTEGER) + 1, 1)" for i in range(8) for j in range(4))
WARC = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, true AS intact FROM p
"""
