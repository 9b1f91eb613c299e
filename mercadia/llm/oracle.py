"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from mercadia.llm import licenses, quality_rules
from mercadia.llm.positional_index import SHARE, SLOP, WINDOW_WORDS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_verdicts() -> str:
    """The pages hold no canonical links or redirects, so classes are equal normalised URLs."""
    return r"""
    WITH RECURSIVE places AS (
      SELECT page_id, url,
        lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host,
        regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
        list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), '&'),
          lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept
      FROM pages),
    nodes AS (
      SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '')
        || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS node FROM places),
    rules(rule_host, rule_path, rule_verdict) AS (VALUES
      ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    fits AS (
      SELECT DISTINCT n.host, n.path, rule_host || rule_path AS rule, rule_verdict FROM nodes n JOIN rules
        ON (n.host = rule_host OR suffix(n.host, '.' || rule_host)) AND starts_with(n.path, rule_path)),
    decided AS (
      SELECT host, path, rule, rule_verdict FROM fits
      QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule_verdict) = 1),
    classes AS (
      SELECT node, bool_or(rule_verdict = 'allow') AS allows, bool_or(rule_verdict = 'block') AS blocks
      FROM nodes LEFT JOIN decided USING (host, path) WHERE node IS NOT NULL GROUP BY node)
    SELECT page_id, n.host, n.path, rule,
      coalesce(rule_verdict, CASE WHEN blocks AND NOT coalesce(allows, false) THEN 'block' ELSE 'allow' END) AS verdict,
      n.node, n.node AS class_root
    FROM nodes n LEFT JOIN decided USING (host, path) LEFT JOIN classes c ON n.node = c.node"""


def quality() -> str:
    stops = ", ".join(sorted({quoted(f) for w in quality_rules.STOP_WORDS.split() for f in (w, w.capitalize())}))
    checks = []
    for rule in quality_rules.RULES:
        bounds = [f"{rule.measure} < {rule.low}"] * (rule.low is not None) + [f"{rule.measure} > {rule.high}"] * (rule.high is not None)
        checks.append(f"CASE WHEN {' OR '.join(bounds)} THEN {quoted(rule.name)} END")
    return rf"""
    WITH rows AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    cut AS (
      SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM rows),
    spans AS (
      SELECT r, k, array_to_string(words[k : k + 7], ' ') AS span FROM cut, LATERAL (SELECT unnest(range(1, len(words) - 6)) AS k) t
      WHERE len(words) >= 8),
    twice AS (SELECT r, k, count(*) OVER (PARTITION BY r, span) AS n FROM spans),
    covered AS (
      SELECT r, sum(least(8, k - before)) AS n_repeat_words FROM
        (SELECT r, k, coalesce(lag(k) OVER (PARTITION BY r ORDER BY k), k - 8) AS before FROM twice WHERE n > 1) GROUP BY r),
    counts AS (
      SELECT r, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda w: list_contains([{stops}], w))) AS stops,
        len(regexp_extract_all(text, '[^\p{{L}}\x20\x09-\x0D]')) AS others,
        len(regexp_extract_all(text, '\p{{Lu}}')) AS capitals, len(regexp_extract_all(text, '!')) AS exclaimed
      FROM cut LEFT JOIN covered USING (r)),
    measures AS (
      SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_length,
        coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
        coalesce(stops / nullif(n_words, 0), 0) AS stop_word_ratio,
        coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS duplicate_line_ratio,
        CASE WHEN word_chars > others THEN capitals / (word_chars - others) ELSE 0 END AS capital_ratio,
        coalesce((word_chars - others) / nullif(word_chars, 0), 0) AS letter_ratio,
        coalesce(exclaimed / nullif(n_words, 0), 0) AS exclamations_per_word FROM counts),
    judged AS (SELECT *, list_filter([{', '.join(checks)}], lambda c: c IS NOT NULL) AS found FROM measures)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND len(found) = 0 AS kept, array_to_string(found, ',') AS broken_rules FROM judged"""


def contamination(columns: str) -> str:
    """Exact and proximity matches, each pair of a text and a window by itself."""
    size = WINDOW_WORDS

    def words(column: str) -> str:
        lower = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return rf"list_filter(regexp_split_to_array({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

    return f"""
    WITH items AS (SELECT item_id::VARCHAR AS item, {words('text')} AS words FROM benchmark),
    windows AS (
      SELECT DISTINCT array_to_string(words[k : k + least(len(words), {size}) - 1], ' ') AS phrase,
        least(len(words), {size}) AS size, item
      FROM items, LATERAL (SELECT unnest(range(1, len(words) - least(len(words), {size}) + 2)) AS k) t WHERE len(words) > 0),
    rows AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS words FROM documents),
    sizes AS (SELECT DISTINCT size FROM windows),
    spans AS (
      SELECT r, k, size, array_to_string(words[k : k + size - 1], ' ') AS phrase
      FROM rows, sizes, LATERAL (SELECT unnest(range(1, len(words) - size + 2)) AS k) t WHERE len(words) >= size),
    hits AS (SELECT r, k, s.size, item FROM spans s JOIN windows w ON s.phrase = w.phrase AND s.size = w.size),
    hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM hits) GROUP BY r),
    named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r),
    needs AS (
      SELECT phrase, any_value(size) AS size, greatest(1, (any_value(size) * {SHARE} + 99) // 100) AS need FROM windows GROUP BY phrase),
    offsets AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS term, generate_subscripts(string_split(phrase, ' '), 1) AS o FROM needs),
    positions AS (SELECT r, unnest(words) AS term, generate_subscripts(words, 1) AS p FROM rows),
    likely AS (
      SELECT r, phrase FROM (SELECT DISTINCT r, term FROM positions) JOIN
        (SELECT phrase, term, count(*) AS times FROM offsets GROUP BY 1, 2) USING (term) JOIN needs USING (phrase)
      GROUP BY r, phrase, need HAVING sum(times) >= need),
    starts AS (
      SELECT r, phrase, term, o, p, p - o AS s FROM likely JOIN offsets USING (phrase) JOIN positions USING (r, term)),
    firsts AS (SELECT DISTINCT r, phrase, s AS low FROM starts),
    words_met AS (
      SELECT r, phrase, low, term, least(count(DISTINCT o), count(DISTINCT p)) AS met
      FROM firsts JOIN starts USING (r, phrase) WHERE s BETWEEN low AND low + {SLOP} GROUP BY ALL),
    near AS (
      SELECT DISTINCT r, phrase FROM (SELECT r, phrase, low, sum(met) AS met FROM words_met GROUP BY ALL) JOIN needs USING (phrase)
      WHERE met >= need),
    near_named AS (
      SELECT r, count(DISTINCT item) AS n_near_items, string_agg(DISTINCT item, ',' ORDER BY item) AS near_items
      FROM near JOIN windows USING (phrase) GROUP BY r)
    SELECT {columns}
    FROM rows LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN near_named USING (r)"""


CONTAMINATION = """doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
      coalesce(n_near_items, 0)::BIGINT AS n_near_items, coalesce(near_items, '') AS near_items"""


def licence_report() -> str:
    """The same tables of sentences and licences, read by SQL over every sentence of every text."""

    def name(known: licenses.Sentence) -> str:
        if not known.tail:
            return quoted(known.name)
        tail = f"regexp_extract(s, {quoted('^(?:' + known.pattern + ')')}, {known.tail})"
        return f"{quoted(known.name)} || regexp_replace({tail}, '[^a-z0-9]', '', 'g')"

    cases = " ".join(f"WHEN regexp_matches(s, {quoted('^(?:' + p.pattern + ')')}) THEN {name(p)}" for p in licenses.SENTENCES)
    read = "',' || array_to_string(ids, ',,') || ','"
    for known in licenses.LICENCES:
        read = f"replace({read}, {quoted(',' + ',,'.join(known.sentences) + ',')}, {quoted('<' + known.name + '>')})"
    return rf"""
    WITH marked AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_replace(
        regexp_replace(text, '^[ \t]*(?://+|/\*+|\*+/?|#+|--+|;+|<!--|%+)', '', 'gm'),
        '(?i)spdx-licen[sc]e-identifier:[ \t]*([a-z0-9.+-]+)', chr(10) || chr(10) || 'spdx-license-identifier-\1' || chr(10) || chr(10), 'g') AS plain
      FROM documents),
    cut AS (
      SELECT r, unnest(string_split(regexp_replace(regexp_replace(plain, '([.;:!?])\s+', '\1' || chr(1), 'g'),
        '\s*\n\s*\n\s*', chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(regexp_replace(plain,
        '([.;:!?])\s+', '\1' || chr(1), 'g'), '\s*\n\s*\n\s*', chr(1), 'g'), chr(1)), 1) AS k FROM marked WHERE plain IS NOT NULL),
    normal AS (
      SELECT r, k, regexp_replace(trim(regexp_replace(regexp_replace(lower(s), '["''`“”‘’*;:]+', '', 'g'), '\s+', ' ', 'g')),
        '[ .!?,]+$', '') AS s FROM cut),
    known AS (SELECT r, k, CASE {cases} END AS id FROM normal WHERE s <> ''),
    lists AS (SELECT r, list(id ORDER BY k) AS ids FROM known WHERE id IS NOT NULL GROUP BY r),
    texts AS (SELECT doc_id, coalesce(ids, []) AS ids FROM marked LEFT JOIN lists USING (r)),
    found AS (SELECT *, regexp_extract_all(read, '<([^>]+)>', 1) AS licences, regexp_extract_all(read, ',([A-Za-z0-9]+),', 1) AS unmatched
      FROM (SELECT *, {read} AS read FROM texts))
    SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
      array_to_string(licences, ',') AS licences, array_to_string(list_sort(list_distinct(licences)), '+') AS expression,
      array_to_string(unmatched, ',') AS unmatched FROM found"""


def trie() -> str:
    """Nodes as lists of turns; crc32 by its definition, bit by bit over the bytes of the decimal number."""
    bits = "list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda a, b: {bits}), 4294967295)"
    return rf"""
    WITH RECURSIVE turns AS (
      SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
      FROM conversations WHERE conv_id IS NOT NULL),
    lists AS (SELECT conv_id, list(said ORDER BY place) AS own FROM turns GROUP BY conv_id),
    crcs AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, ({crc}) % 6 AS h FROM lists),
    rebuilt AS (
      SELECT c.conv_id, coalesce(b.own, [])[1 : c.h] || c.own[c.h + 1 :] AS said FROM crcs c LEFT JOIN lists b ON c.base = b.conv_id),
    members AS (
      SELECT conv_id, d AS depth, said[1 : d] AS node, said[1 : d - 1] AS parent, d = len(said) AS ends, coalesce(length(said[d].text), 0) AS chars
      FROM rebuilt, LATERAL (SELECT unnest(range(0, len(said) + 1)) AS d) t),
    named AS (
      SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
        bool_and(ends) AS leaf, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
      FROM members GROUP BY depth, node),
    below AS (
      SELECT m.depth, m.node, sum(n.leaf::BIGINT) AS n_leaves, sum(n.saved) AS saved_tokens
      FROM named n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.depth, m.node),
    children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM named WHERE depth > 0 GROUP BY depth, parent)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
      b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM named n JOIN below b ON n.depth = b.depth AND n.node = b.node
      LEFT JOIN children c ON n.depth = c.depth AND n.node = c.node
      LEFT JOIN named p ON n.depth - 1 = p.depth AND n.parent = p.node"""


def llm_oracle() -> dict[str, str]:
    return {
        "op4_redirect_equivalence": url_verdicts(),
        "op6_quality_rules": quality(),
        "op7_licence_sentences": licence_report(),
        "op9_positional_index_decontamination": contamination(CONTAMINATION),
        "op9_exact_and_proximity_matches": contamination(CONTAMINATION),
        "near_benchmark_passages": contamination("doc_id, near_items, coalesce(n_hit, 0) > 0 AS exact") + " WHERE near_items IS NOT NULL",
        "op12_conversation_prefix_trie": trie(),
    }
