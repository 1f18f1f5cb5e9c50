"""The core's queries once more, in the SQL of DuckDB."""

from __future__ import annotations

import unicodedata

from folioloom.functions import text as tx
from folioloom.operators import voices as vx
from folioloom.plans.headings import HEADINGS

_WS = r"[\s\p{Z}]"
_TITLES = ", ".join("'" + t + "'" for t in tx.TITLES)
_F = ", ".join("'" + t + "'" for t in tx.FEMALE_TITLES)
_M = ", ".join("'" + t + "'" for t in tx.MALE_TITLES)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def last_word(x: str) -> str:
    return rf"regexp_extract({strip(x)}, '[^\s\p{{Z}}]+$')"


def bare(x: str) -> str:
    return f"rtrim(lower({x}), '.')"


def proper(x: str) -> str:
    b = strip(rf"""regexp_replace({strip(x)}, '^["''“”‘’ ]+|["''“”‘’ ]+$', '', 'g')""")
    return (
        f"CASE WHEN length({b}) > 0 AND length({b}) <= 60 AND len(list_filter(regexp_extract_all({b}, '[\\p{{L}}\\p{{N}}_''’\\-]+'), "
        f"lambda w: regexp_matches(w, '^\\p{{Lu}}') AND {bare('w')} NOT IN ({_TITLES}))) > 0 THEN {b} END"
    )


def title_gender(x: str) -> str:
    words = f"list_transform(regexp_extract_all({x}, '[A-Za-zÀ-ÿ.]+'), lambda w: {bare('w')})"
    return f"CASE WHEN list_has_any({words}, [{_F}]) THEN 'female' WHEN list_has_any({words}, [{_M}]) THEN 'male' END"


def note_genders(x: str) -> str:
    said = f"list_filter(coalesce(map_extract_value({x}, 'gender'), []), lambda g: g IS NOT NULL AND {strip('g')} != '')"
    return f"list_distinct(list_transform({said}, lambda g: lower(regexp_extract({strip('g')}, '^[^\\s\\p{{Z}}]+'))))"


def texts(x: str) -> str:
    return f"list_filter(coalesce({x}, []), lambda a: a IS NOT NULL AND {strip('a')} != '')"


def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition is one ASCII character, and those whose is several."""
    one, more = {}, {}
    for c in map(chr, range(0x80, 0x20000)):
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if plain and plain != c:
            (one if len(plain) == 1 else more)[c] = plain
    return one, more


def ascii_of(x: str) -> str:
    """A text decomposed, without what is not ASCII."""
    one, more = _decomposed()
    out = f"translate({x}, '{''.join(one)}', '{''.join(one.values()).replace(chr(39), chr(39) * 2)}')"
    for c in "…ﬀﬁﬂﬃﬄ™№½¼¾‥":
        out = f"replace({out}, '{c}', '{more[c]}')"
    return f"regexp_replace({out}, '[^\\x00-\\x7F]', '', 'g')"


def slug(x: str) -> str:
    return f"CASE WHEN trim(regexp_replace(lower({ascii_of(x)}), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'someone' ELSE trim(regexp_replace(lower({ascii_of(x)}), '[^a-z0-9]+', '_', 'g'), '_') END"


def folded(x: str) -> str:
    return f"regexp_replace(lower({ascii_of(x)}), '[^a-z ]', '', 'g')"


def ascii_tokens(x: str) -> str:
    words = f"list_filter(regexp_extract_all({x}, '[A-Za-z''\\-]+'), lambda w: regexp_matches(w, '^[A-Z]') AND {bare('w')} NOT IN ({_TITLES}))"
    return f"list_transform({words}, lambda w: {bare('w')})"


SCRIPT = "script AS (SELECT * FROM script_segments QUALIFY row_number() OVER (PARTITION BY book_id, n, id ORDER BY loaded_at DESC, seg_key DESC) = 1)"
TEXTS = SCRIPT + ", texts AS (SELECT * FROM script WHERE text IS NOT NULL)"
CAST = "roster AS (SELECT * FROM cast_members QUALIFY row_number() OVER (PARTITION BY book_id, id ORDER BY updated_at DESC, entry_id DESC) = 1)"
SPOKEN = "spoken AS (SELECT * FROM script WHERE kind = 'quote' AND speaker NOT IN ('unknown', 'narrator'))"
COUNTS = SPOKEN + """, counts AS (
    SELECT book_id, speaker, count(*) AS lines, min((n, id)) AS f FROM spoken GROUP BY book_id, speaker)"""
DURATIONS = TEXTS + ", durations AS (SELECT book_id, n, CAST(floor(sum(length(text)) * 1000 / 15) AS BIGINT) AS ms FROM texts GROUP BY book_id, n)"
INDEX = "idx AS (SELECT book_id, n, title FROM chapters QUALIFY row_number() OVER (PARTITION BY book_id, n ORDER BY loaded_at DESC, chapter_id DESC) = 1)"
BOOKS = """about AS (SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY book_id
    ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST, author DESC NULLS LAST) = 1)"""

_FIRST = f"""list_filter(regexp_split_to_array({strip('name')}, '{_WS}+'), lambda w: {bare('w')} NOT IN ({_TITLES}))"""

NAME_INDEX = CAST + rf""", base AS (
    SELECT *, {texts('aliases')} AS al, {texts('epithets')} AS ep, coalesce({title_gender('name')},
        CASE WHEN len({note_genders('notes')}) = 1 THEN {note_genders('notes')}[1] END) AS g
    FROM roster WHERE name IS NOT NULL AND {strip('name')} != ''
), names AS (
    SELECT book_id, id, ord, entry_id, unnest(list_concat(list_concat([name], al), ep)) AS nm FROM base
), firsts AS (
    SELECT book_id, lower(({_FIRST})[1]) AS key, min((ord, entry_id, id)) AS f, count(DISTINCT id) AS ids FROM base
    WHERE len({_FIRST}) > 1 GROUP BY ALL
), keys AS (
    SELECT book_id, unnest([lower(nm), regexp_replace(lower(nm), '^the ', ''), lower({last_word('nm')})]) AS key, id, 1 AS way, ord, entry_id FROM names
    UNION ALL
    SELECT book_id, unnest(CASE g WHEN 'male' THEN ['m.'] WHEN 'female' THEN ['madame', 'mademoiselle'] ELSE [] END)
        || ' ' || lower({last_word('name')}), id, 2, ord, entry_id FROM base
    UNION ALL
    SELECT book_id, key, f[3], 3, f[1], f[2] FROM firsts WHERE ids = 1
), name_index AS (
    SELECT book_id, key, id FROM keys QUALIFY row_number() OVER (PARTITION BY book_id, key ORDER BY way, ord, entry_id) = 1
)"""
NAME_INDEX = NAME_INDEX.replace("f[3], 3, f[1], f[2]", "struct_extract_at(f, 3), 3, struct_extract_at(f, 1), struct_extract_at(f, 2)")

_TAG = (
    r"^(?:[\p{L}\p{N}_’'']+[\s\p{Z}]+){0,3}?(?:" + tx.VERBS + r")[\s\p{Z}]+((?:the[\s\p{Z}]+|M\.[\s\p{Z}]+|Madame[\s\p{Z}]+|Mademoiselle[\s\p{Z}]+)?"
    r"[A-Z][\p{L}\p{N}_’é\-]+)"
)

TAGGED = SCRIPT + ", " + NAME_INDEX + rf""", ahead AS (
    SELECT *, lead(kind) OVER w AS nk, lead(para) OVER w AS np, lead(text) OVER w AS nt FROM script WINDOW w AS (PARTITION BY book_id, n ORDER BY id)
), named AS (
    SELECT *, CASE WHEN kind = 'quote' AND nk = 'narration' AND np = para THEN nullif(lower(regexp_extract(nt, '{_TAG}', 1)), '') END AS nm FROM ahead
), met AS (
    SELECT s.*, coalesce(a.id, b.id) AS who FROM named s
    LEFT JOIN name_index a ON a.book_id = s.book_id AND a.key = s.nm
    LEFT JOIN name_index b ON b.book_id = s.book_id AND b.key = regexp_replace(s.nm, '^the ', '')
), tagged AS (
    SELECT * EXCLUDE (speaker, tag_override), (who IS NOT NULL AND speaker IS DISTINCT FROM who) AS now,
        CASE WHEN who IS NOT NULL AND speaker IS DISTINCT FROM who THEN who ELSE speaker END AS speaker,
        CASE WHEN who IS NOT NULL AND speaker IS DISTINCT FROM who THEN true ELSE tag_override END AS tag_override FROM met
)"""

_BATCHED = """batched AS (
    SELECT *, CAST(floor(greatest(so_far - 1, 0) / per) AS INTEGER) AS batch FROM (
        SELECT *, CASE WHEN total = 0 THEN 1 ELSE ceil(total / ceil(total / {most}.0)) END AS per FROM (
            SELECT *, sum(CASE WHEN kind = 'quote' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, n) AS total,
                sum(CASE WHEN kind = 'quote' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, n ORDER BY id ROWS UNBOUNDED PRECEDING) AS so_far
            FROM {source})))"""

_GENDER = f"""CASE WHEN g LIKE '%female%' OR g LIKE 'f%' THEN 'female' ELSE 'male' END"""
_TOLD = """CASE WHEN json_valid(persona) THEN json_extract_string(CASE WHEN json_valid(persona) THEN persona END, '$.gender') END"""
VOICES = COUNTS + ", " + CAST + rf""", gendered AS (
    SELECT book_id, id AS speaker, {_GENDER} AS gender FROM (
        SELECT book_id, id, lower(CASE WHEN {_TOLD} != '' THEN {_TOLD}
            ELSE array_to_string(coalesce(map_extract_value(notes, 'gender'), []), '/') END) AS g FROM roster)
), turns AS (
    SELECT c.book_id, c.speaker, gender, row_number() OVER (PARTITION BY c.book_id, gender ORDER BY lines DESC, f) - 1 AS turn
    FROM counts c JOIN gendered g ON g.book_id = c.book_id AND g.speaker = c.speaker
), voices AS (
    SELECT book_id, speaker, CASE gender WHEN 'female' THEN 'extra_female_' || (turn % 2 + 1) ELSE 'extra_male_' || (turn % 3 + 1) END AS voice FROM turns
)"""

NARRATION = rf"""opening AS (
    SELECT book_id, text FROM chapters WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY n, loaded_at DESC, chapter_id DESC) = 1
), narration AS (
    SELECT book_id, coalesce({strip('l[1]')}, 'It was a story told many times, and never quite the same way twice.') AS line FROM (
        SELECT book_id, list_filter(flatten(list_transform(string_split(text, chr(10) || chr(10)),
            lambda p: string_split(regexp_replace(p, '([.!?]){_WS}+', '\1' || chr(31), 'g'), chr(31)))),
            lambda x: length(x) BETWEEN 60 AND 220 AND NOT contains(x, '“') AND NOT starts_with(lower(x), 'chapter') AND NOT starts_with(lower(x), 'volume')) AS l
        FROM opening)
)"""

_SOUND = "sound AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 9)) AS a FROM embeddings)"


def chunked(source: str, keys: str) -> str:
    """Greedy packing, as a recursion over sentences."""
    return rf"""parts AS (
        SELECT {keys}, string_split(regexp_replace(text, '([.!?;]){_WS}+', '\1' || chr(31), 'g'), chr(31)) AS p, text FROM {source}
    ), packed AS (
        SELECT {keys}, text, CASE WHEN length(text) <= 400 THEN {{'done': [text], 'cur': ''}} ELSE list_reduce(
            list_transform(p, lambda s: {{'done': CAST([] AS VARCHAR[]), 'cur': s}}),
            lambda a, x: CASE WHEN a.cur != '' AND length(a.cur) + length(x.cur) > 400 THEN {{'done': list_append(a.done, a.cur), 'cur': x.cur}}
                ELSE {{'done': a.done, 'cur': {strip("a.cur || ' ' || x.cur")}}} END,
            {{'done': CAST([] AS VARCHAR[]), 'cur': ''}}) END AS r FROM parts
    ), pieces AS (
        SELECT {keys}, CASE WHEN r.cur != '' THEN list_append(r.done, r.cur) ELSE r.done END AS l FROM packed
    )"""


ORACLE: dict[str, str] = {
    "html_to_text": rf"""
        WITH p AS (SELECT chapter_id, n, list_filter(list_transform(string_split_regex(text, '\n[\s]*\n'),
            lambda x: {strip(f"regexp_replace(x, '{_WS}+', ' ', 'g')")}), lambda x: x != '') AS l FROM chapters WHERE text IS NOT NULL)
        SELECT chapter_id, 'Chapter ' || n AS heading, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS chars
        FROM (SELECT chapter_id, n, array_to_string(list_concat(['Chapter ' || n], l), chr(10) || chr(10)) AS t FROM p)
    """,
    "chapter_filter": rf"""
        WITH k AS (SELECT *, {strip("regexp_replace(regexp_extract(text, '^[^\\n]*'), '[\\s\\p{Z}]+', ' ', 'g')")} AS heading FROM chapters WHERE text IS NOT NULL)
        SELECT chapter_id, book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY n, chapter_id) AS INTEGER) AS number, heading
        FROM k WHERE regexp_matches(heading, '(?i)^(?:{HEADINGS})')
    """,
    "chapter_index": """
        SELECT chapter_id, title, CAST(length(coalesce(text, '')) AS INTEGER) AS chars,
            CAST(length(coalesce(text, '')) * 2 - length(replace(coalesce(text, ''), '“', '')) - length(replace(coalesce(text, ''), '"', '')) AS INTEGER) AS quotes
        FROM chapters
    """,
    "spine_join": "SELECT book_id, n AS pos, 'OEBPS/item' || chapter_id || '.xhtml' AS href FROM chapters",
    "book_metadata": """
        SELECT book_id, loaded_at, coalesce(regexp_replace(title, '[<>&]', ' ', 'g'), '') AS title,
            string_split(coalesce(regexp_replace(author, '[<>&]', ' ', 'g'), '') || ' and Others', ' and ')[1] AS author, coalesce(language, '') AS language
        FROM books
    """,
    "batches": f"WITH {SCRIPT}, {_BATCHED.format(source='script', most=12)} SELECT book_id, n, id, batch FROM batched",
    "batch_bounds": f"""
        WITH {SCRIPT}, {_BATCHED.format(source='script', most=12)}
        SELECT book_id, n, batch, min(id) AS first_id, max(id) + 1 AS end_id, CAST(sum(CASE WHEN kind = 'quote' THEN 1 ELSE 0 END) AS BIGINT) AS quotes
        FROM batched GROUP BY book_id, n, batch
    """,
    "batch_prompts": f"""
        WITH {TEXTS}, {_BATCHED.format(source='texts', most=12)}, lined AS (
            SELECT *, CASE WHEN kind = 'quote' THEN '[Q' || id || '] "' || text || '"' ELSE text END AS line,
                coalesce(string_agg(text, ' ') OVER (PARTITION BY book_id, n ORDER BY id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), '') AS earlier
            FROM batched)
        SELECT book_id, n, batch, md5(arg_min(earlier, id)) AS earlier_md5, md5(string_agg(line, chr(10) ORDER BY id)) AS body_md5
        FROM lined GROUP BY book_id, n, batch
    """,
    "current_cast": f"WITH {CAST} SELECT book_id, id, entry_id, name, lines FROM roster",
    "proper_alias": f"""
        SELECT DISTINCT entry_id, said, {proper('said')} AS proper
        FROM (SELECT entry_id, unnest(list_concat([name], coalesce(aliases, []))) AS said FROM cast_members) WHERE said IS NOT NULL
    """,
    "name_genders": f"""
        SELECT entry_id, {title_gender('name')} AS by_title,
            coalesce({title_gender('name')}, CASE WHEN len({note_genders('notes')}) = 1 THEN {note_genders('notes')}[1] END) AS gender FROM cast_members
    """,
    "name_index": f"WITH {NAME_INDEX} SELECT book_id, key, id FROM name_index",
    "cast_summary": f"""
        WITH {CAST} SELECT book_id, id, name || CASE WHEN len({texts('aliases')}) > 0 AND array_to_string({texts('aliases')}, ', ') != ''
            THEN ' | ' || array_to_string({texts('aliases')}, ', ') ELSE '' END AS line FROM roster
    """,
    "first_names_once": f"""
        WITH {CAST} SELECT book_id, lower(({_FIRST})[1]) AS first_name FROM roster WHERE name IS NOT NULL AND len({_FIRST}) > 1
        GROUP BY book_id, lower(({_FIRST})[1]) HAVING count(DISTINCT id) = 1
    """,
    "dedupe_pairs": f"""
        WITH {CAST}, who AS (
            SELECT book_id, id, ord, entry_id, lower({proper('name')}) AS own, {note_genders('notes')} AS genders,
                list_distinct(list_filter(list_transform(list_concat([name], {texts('aliases')}), lambda x: lower({proper('x')})), lambda x: x IS NOT NULL)) AS names
            FROM roster WHERE len(chapters) > 0)
        SELECT a.book_id, a.id AS a, b.id AS b FROM who a JOIN who b
            ON a.book_id = b.book_id AND (a.ord, a.entry_id) < (b.ord, b.entry_id)
            AND (list_contains(b.names, a.own) OR list_contains(a.names, b.own))
        WHERE NOT (len(a.genders) > 0 AND len(b.genders) > 0 AND NOT list_has_any(a.genders, b.genders))
    """,
    "cast_ranked": f"""
        WITH {CAST} SELECT book_id, id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY len(coalesce(chapters, [])) DESC,
            coalesce(starts_with(lower(name), 'the '), NULL) ASC NULLS FIRST, coalesce(lines, 0) DESC, ord, entry_id) AS INTEGER) AS place FROM roster
    """,
    "cast_totals": f"WITH {CAST} SELECT book_id, count(*) AS characters, count(*) FILTER (len(chapters) > 0) AS speaking FROM roster GROUP BY book_id",
    "cast_notes": """
        WITH e AS (SELECT book_id, id, unnest(map_entries(notes)) AS e FROM cast_members),
        v AS (SELECT book_id, id, e.key AS note, unnest(e.value) AS v FROM e)
        SELECT book_id, id, note, list_sort(list(DISTINCT v)) AS values FROM v WHERE v IS NOT NULL AND trim(v) != '' GROUP BY book_id, id, note
    """,
    "tag_names": rf"""
        WITH {TEXTS} SELECT book_id, n, id, regexp_extract(text, '{_TAG}', 1) AS name FROM texts
        WHERE kind = 'narration' AND regexp_extract(text, '{_TAG}', 1) != ''
    """,
    "tag_override": f"WITH {TAGGED} SELECT book_id, n, id, speaker FROM tagged WHERE now",
    "checked_speakers": f"""
        WITH {SCRIPT}, {CAST} SELECT s.book_id, s.n, s.id,
            CASE WHEN r.id IS NOT NULL OR s.speaker = 'narrator' THEN s.speaker ELSE 'unknown' END AS speaker
        FROM script s LEFT JOIN roster r ON r.book_id = s.book_id AND r.id = s.speaker
    """,
    "attribution_stats": f"""
        WITH {TAGGED} SELECT book_id, n, count(*) FILTER (kind = 'quote') AS quotes,
            count(*) FILTER (kind = 'quote' AND coalesce(tag_override, false)) AS overrides,
            count(*) FILTER (kind = 'quote' AND speaker = 'unknown') AS unknown FROM tagged GROUP BY book_id, n
    """,
    "speaker_quotes": f"""
        WITH {TAGGED} SELECT book_id, speaker, count(*) AS quotes, count(*) FILTER (now) AS by_tag
        FROM tagged WHERE kind = 'quote' GROUP BY book_id, speaker
    """,
    "read_labels": f"""
        WITH {SCRIPT} SELECT s.seg_key,
            CASE WHEN s.seg_key % 5 IN (0, 1, 2) AND EXISTS (SELECT 1 FROM cast_members c WHERE c.id = s.speaker
                AND c.book_id = CASE WHEN s.seg_key % 7 = 6 THEN 'bk00000000' ELSE s.book_id END) THEN s.speaker ELSE 'unknown' END AS speaker,
            CASE WHEN s.seg_key % 5 IN (0, 2, 3) AND coalesce(emotion, '') != '' THEN emotion ELSE 'neutral' END AS emotion
        FROM script s WHERE kind = 'quote'
    """,
    "accuracy": """
        WITH s AS (SELECT * FROM script_segments WHERE kind = 'quote'),
        p AS (SELECT book_id, n, id, speaker, tag_override FROM s QUALIFY row_number() OVER (PARTITION BY book_id, n, id ORDER BY loaded_at, seg_key) = 1),
        g AS (SELECT book_id, n, id, speaker AS gold FROM s QUALIFY row_number() OVER (PARTITION BY book_id, n, id ORDER BY loaded_at DESC, seg_key DESC) = 1)
        SELECT book_id, count(*) AS quotes, count(*) FILTER (gold IS NOT DISTINCT FROM speaker AND NOT coalesce(tag_override, false)) AS model_only,
            count(*) FILTER (gold IS NOT DISTINCT FROM speaker) AS with_tag_override,
            round(count(*) FILTER (gold IS NOT DISTINCT FROM speaker) / count(*), 6) AS share,
            CAST(count(*) FILTER (gold IS DISTINCT FROM speaker) AS INTEGER) AS wrong
        FROM p JOIN g USING (book_id, n, id) GROUP BY book_id
    """,
    "spoken_lines": f"""
        WITH {TEXTS} SELECT book_id, speaker, CAST(count(*) AS INTEGER) AS n, md5(string_agg(text, chr(10) ORDER BY n, id)) AS lines_md5
        FROM texts WHERE kind = 'quote' AND speaker NOT IN ('unknown', 'narrator') GROUP BY book_id, speaker
    """,
    "line_counts": f"""
        WITH {SCRIPT}, {COUNTS} SELECT book_id, speaker, lines, struct_extract_at(f, 1) AS first_n, struct_extract_at(f, 2) AS first_id FROM counts
    """,
    "speakers_by_lines": f"""
        WITH {SCRIPT}, {COUNTS} SELECT book_id, speaker, lines,
            CAST(row_number() OVER (PARTITION BY book_id ORDER BY lines DESC, f) AS INTEGER) AS place FROM counts
    """,
    "spoken_by_cast": f"""
        WITH {SCRIPT}, {COUNTS}, {CAST} SELECT c.book_id, c.speaker, r.name, c.lines FROM counts c JOIN roster r ON r.book_id = c.book_id AND r.id = c.speaker
    """,
    "pick_line": rf"""
        WITH {TEXTS}, s AS (SELECT *, length(text) BETWEEN 60 AND 220 AS good, regexp_matches(text, '[.!?]{_WS}*$') AS whole FROM texts
            WHERE kind = 'quote' AND speaker NOT IN ('unknown', 'narrator'))
        SELECT book_id, speaker, text AS line FROM s QUALIFY row_number() OVER (PARTITION BY book_id, speaker ORDER BY
            CASE WHEN good THEN 0 ELSE 1 END, CASE WHEN good AND whole THEN 0 ELSE 1 END,
            CASE WHEN good THEN abs(length(text) - 140) ELSE -length(text) END, n, id) = 1
    """,
    "narration_line": f"WITH {NARRATION} SELECT book_id, line FROM narration",
    "stock_voices": f"WITH {SCRIPT}, {VOICES} SELECT book_id, speaker, voice FROM voices",
    "voice_map": f"""
        WITH {SCRIPT}, {VOICES} SELECT s.book_id, CASE WHEN s.kind = 'quote' THEN coalesce(v.voice, 'narrator') ELSE 'narrator' END AS voice, count(*) AS segments
        FROM script s LEFT JOIN voices v ON v.book_id = s.book_id AND v.speaker = s.speaker GROUP BY ALL
    """,
    "first_sightings": f"WITH {CAST} SELECT book_id, id, chapters[1] AS first_chapter FROM roster WHERE len(chapters) > 0",
    "chunk_text": f"""
        WITH src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {chunked('src', 'doc_id')}
        SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk, unnest(l) AS piece FROM pieces
    """,
    "lexicon": """
        WITH e AS (SELECT * FROM pronunciations WHERE name IS NOT NULL AND respelling IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY book_id, name ORDER BY loaded_at DESC, pron_id DESC) = 1)
        SELECT book_id, name, respelling, CAST(row_number() OVER (PARTITION BY book_id ORDER BY length(name) DESC, ord, pron_id) AS INTEGER) AS place FROM e
    """,
    "lexicon_apply": r"""
        SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{N}_])Old Isker($|[^\p{L}\p{N}_])', '\1Owld Eye-sker\2', 'g'),
            '(^|[^\p{L}\p{N}_])Isker($|[^\p{L}\p{N}_])', '\1EYE-sker\2', 'g'),
            '(^|[^\p{L}\p{N}_])Mrs($|[^\p{L}\p{N}_])', '\1Missis\2', 'g')) AS spoken_md5 FROM documents WHERE text IS NOT NULL
    """,
    "pause_timeline": f"""
        WITH {TEXTS}, {VOICES}, voiced AS (
            SELECT s.book_id, s.n, s.id, s.para, s.text, CASE WHEN s.kind = 'quote' THEN coalesce(v.voice, 'narrator') ELSE 'narrator' END AS voice
            FROM texts s LEFT JOIN voices v ON v.book_id = s.book_id AND v.speaker = s.speaker
        ), {chunked('voiced', 'book_id, n, id, para, voice')}, clips AS (
            SELECT book_id, n, id, para, voice, generate_subscripts(l, 1) AS chunk, unnest(l) AS piece FROM pieces
        ), gaps AS (
            SELECT *, CASE WHEN lag(id) OVER w IS NULL THEN 0.0 ELSE greatest(CASE WHEN lag(para) OVER w != para THEN 0.7 ELSE 0.25 END,
                CASE WHEN lag(voice) OVER w != voice THEN 0.4 ELSE 0 END) END AS pause
            FROM clips WINDOW w AS (PARTITION BY book_id, n ORDER BY id, chunk))
        SELECT book_id, n, count(*) AS clips, CAST(round(sum(CAST(pause AS DOUBLE)), 2) AS DOUBLE) AS silence, CAST(sum(length(piece)) AS BIGINT) AS chars
        FROM gaps GROUP BY book_id, n
    """,
    "chapter_offsets": f"""
        WITH {DURATIONS} SELECT book_id, n, CAST(coalesce(sum(ms) OVER w, 0) AS BIGINT) AS start_ms, CAST(coalesce(sum(ms) OVER w, 0) + ms AS BIGINT) AS end_ms
        FROM durations WINDOW w AS (PARTITION BY book_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """,
    "chapter_totals": f"WITH {DURATIONS} SELECT book_id, count(*) AS chapters, CAST(sum(ms) AS BIGINT) AS ms FROM durations GROUP BY book_id",
    "titled_clips": f"""
        WITH {DURATIONS}, {INDEX} SELECT d.book_id, d.n, d.ms, coalesce(i.title, 'Chapter ' || d.n) AS title
        FROM durations d LEFT JOIN idx i ON i.book_id = d.book_id AND i.n = d.n
    """,
    "short_titles": rf"""
        SELECT chapter_id, lpad(CAST(n AS VARCHAR), 3, '0') || ' - ' || replace(regexp_replace(title, '^Chapter{_WS}+\d+\.{_WS}*', ''), '/', '-') || '.m4a' AS file_name
        FROM chapters WHERE title IS NOT NULL
    """,
    "album_folders": f"""
        WITH {BOOKS} SELECT book_id, author || '/' || title || ' (Full Cast)' AS folder FROM about WHERE title IS NOT NULL AND author IS NOT NULL
    """,
    "playlists": rf"""
        WITH {DURATIONS}, {INDEX}, {BOOKS}, lines AS (
            SELECT d.book_id, d.n, coalesce(a.author, '') AS author, coalesce(a.title, '') AS book_title, coalesce(i.title, 'Chapter ' || d.n) AS title, d.ms
            FROM durations d LEFT JOIN idx i ON i.book_id = d.book_id AND i.n = d.n JOIN about a ON a.book_id = d.book_id)
        SELECT book_id, '#EXTM3U' || chr(10) || '#PLAYLIST:' || book_title || ' (Full Cast)' || chr(10) || '#EXTART:' || author || chr(10) || '#EXTALB:'
            || book_title || ' (Full Cast)' || chr(10) || string_agg('#EXTINF:' || CAST(round_even(ms / 1000, 0) AS BIGINT) || ',' || author || ' - ' || title
            || chr(10) || lpad(CAST(n AS VARCHAR), 3, '0') || ' - ' || replace(regexp_replace(title, '^Chapter{_WS}+\d+\.{_WS}*', ''), '/', '-') || '.m4a',
            chr(10) ORDER BY n) || chr(10) AS playlist
        FROM lines GROUP BY book_id, author, book_title
    """,
    "chapter_markers": f"""
        WITH {DURATIONS}, {INDEX}, placed AS (
            SELECT d.book_id, d.n, d.ms, coalesce(i.title, 'Chapter ' || d.n) AS title,
                CAST(coalesce(sum(d.ms) OVER (PARTITION BY d.book_id ORDER BY d.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
            FROM durations d LEFT JOIN idx i ON i.book_id = d.book_id AND i.n = d.n)
        SELECT book_id, ';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || s || chr(10)
            || 'END=' || CAST(s + ms AS BIGINT) || chr(10) || 'title=' || title, chr(10) ORDER BY n) || chr(10) AS metadata FROM placed GROUP BY book_id
    """,
    "limit_array": f"""
        WITH {_SOUND} SELECT vec_id, list_transform(a, lambda x: round(CASE WHEN abs(x) > 0.89
            THEN sign(x) * (0.89 + (1 - 0.89) * tanh((abs(x) - 0.89) / (1 - 0.89))) ELSE x END, 5) + 0.0) AS limited FROM sound
    """,
    "rms_array": f"WITH {_SOUND} SELECT vec_id, round(sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)), 6) AS rms FROM sound",
    "loop_array": f"""
        WITH {_SOUND}, b AS (SELECT vec_id, CASE WHEN len(a) >= 150 THEN a ELSE list_slice(flatten(list_transform(range(CAST(ceil(150 / len(a)) AS BIGINT)), lambda i: a)), 1, 150) END AS b FROM sound)
        SELECT vec_id, CAST(len(b) AS INTEGER) AS samples, round(b[150], 5) + 0.0 AS last FROM b
    """,
    "resample_array": f"""
        WITH {_SOUND} SELECT vec_id, list_transform(range(40), lambda i: round(
            a[CAST(floor(i * (len(a) - 1) / 39.0) AS BIGINT) + 1] + (a[CAST(least(floor(i * (len(a) - 1) / 39.0) + 1, len(a) - 1) AS BIGINT) + 1]
            - a[CAST(floor(i * (len(a) - 1) / 39.0) AS BIGINT) + 1]) * (CAST(i AS DOUBLE) * (len(a) - 1) / 39 - floor(i * (len(a) - 1) / 39.0)), 5) + 0.0) AS resampled FROM sound
    """,
    "concat_clips": """
        SELECT label, list_transform(a, lambda x: round(CAST(x AS DOUBLE), 4) + 0.0) AS samples, CAST(len(a) AS DOUBLE) / 24000.0 AS seconds
        FROM (SELECT label, flatten(list(embedding ORDER BY vec_id)) AS a FROM embeddings GROUP BY label)
    """,
    "tidy_clips": f"""
        WITH {_SOUND}, f AS (SELECT vec_id, list_transform(a, lambda x: CAST(x AS FLOAT)) AS a FROM sound),
        e AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: abs(a[i]) > CAST(0.02 AS FLOAT)) AS loud FROM f),
        c AS (SELECT vec_id, CASE WHEN len(loud) > 0 THEN list_slice(a, greatest(1, loud[1] - 3), least(len(a), loud[len(loud)] + 2)) ELSE a END AS a FROM e),
        r AS (SELECT *, sqrt(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE) * x)) / len(a)) AS level,
            least(1, len(a) // 2) AS n_in, least(4, len(a) // 2) AS n_out FROM c)
        SELECT vec_id, CAST(len(a) AS INTEGER) AS samples, round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: power(
            a[i] * CASE WHEN level > 0.0001 THEN 0.08 / level ELSE 1 END * CASE WHEN i <= n_in THEN 0 ELSE 1 END
            * CASE WHEN i > len(a) - n_out THEN (len(a) - i) / CAST(n_out - 1 AS DOUBLE) ELSE 1 END, 2))) / len(a)), 4) AS rms FROM r
    """,
    "parse_answers": r"""
        SELECT entry_id, CASE WHEN json_valid(j) THEN j END AS json FROM (
            SELECT entry_id, nullif(regexp_extract(regexp_replace('<think>{not this}' || chr(10) || '</think>Here it is:' || chr(10) || persona || chr(10) || 'Done.',
                '(?s)<think>.*?</think>', '', 'g'), '(?s)\{.*\}'), '') AS j FROM cast_members WHERE persona IS NOT NULL)
    """,
    "salvage_instruct": r"""
        WITH raw AS (SELECT entry_id, '{"instruct": ' || CAST(to_json('A "calm" voice for ' || name || '\') AS VARCHAR) || ', "why": "it says "so"}' AS raw FROM cast_members WHERE name IS NOT NULL)
        SELECT entry_id, json_extract_string(regexp_extract(raw, '(?s)"instruct"\s*:\s*("(?:[^"\\]|\\.)*")', 1), '$') AS instruct FROM raw
    """,
    "line_number": "SELECT entry_id, CASE WHEN lines % 3 = 0 OR lines IS NULL THEN 0 ELSE lines END AS lines FROM cast_members",
    "stage_state": """
        SELECT book_id, stage, done, seconds FROM stage_manifest QUALIFY row_number() OVER (PARTITION BY book_id, stage
            ORDER BY done_at DESC NULLS LAST, loaded_at DESC NULLS LAST, done DESC NULLS LAST, seconds DESC NULLS LAST) = 1
    """,
    "next_stages": """
        WITH st AS (SELECT book_id, stage, done FROM stage_manifest
            QUALIFY row_number() OVER (PARTITION BY book_id, stage ORDER BY done_at DESC NULLS LAST, loaded_at DESC NULLS LAST, done DESC NULLS LAST, seconds DESC NULLS LAST) = 1),
        o AS (SELECT unnest(['extract', 'cast', 'attribute', 'voices', 'design', 'render', 'encode', 'publish']) AS stage, unnest(range(8)) AS place)
        SELECT b.book_id, arg_min(o.stage, o.place) AS stage FROM (SELECT DISTINCT book_id FROM stage_manifest) b, o
        WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.book_id = b.book_id AND st.stage = o.stage AND st.done) GROUP BY b.book_id
    """,
    "resume_anti": """
        WITH st AS (SELECT book_id, stage, done FROM stage_manifest QUALIFY row_number() OVER (PARTITION BY book_id, stage
            ORDER BY done_at DESC NULLS LAST, loaded_at DESC NULLS LAST, done DESC NULLS LAST, seconds DESC NULLS LAST) = 1),
        o AS (SELECT unnest(['extract', 'cast', 'attribute', 'voices', 'design', 'render', 'encode', 'publish']) AS stage)
        SELECT b.book_id, o.stage FROM (SELECT DISTINCT book_id FROM books) b, o
        WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.book_id = b.book_id AND st.stage = o.stage AND st.done)
    """,
}

_SEGMENTS = rf"""
    WITH para AS (
        SELECT chapter_id, contains(text, '“') AS curly, unnest(string_split(text, chr(10) || chr(10))) AS p,
            generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS para FROM chapters
    ), tok AS (
        SELECT chapter_id, para, curly, unnest(regexp_extract_all(p, '“[^”]*(?:”|\z)|[^“]+')) AS t,
            generate_subscripts(regexp_extract_all(p, '“[^”]*(?:”|\z)|[^“]+'), 1) AS pos FROM para WHERE curly
        UNION ALL
        SELECT chapter_id, para, curly, unnest(regexp_extract_all(p, '"[^"]*(?:"|\z)|[^"]+')),
            generate_subscripts(regexp_extract_all(p, '"[^"]*(?:"|\z)|[^"]+'), 1) FROM para WHERE NOT curly
    ), seg AS (
        SELECT chapter_id, para, pos, CASE WHEN t LIKE CASE WHEN curly THEN '“%' ELSE '"%' END THEN 'quote' ELSE 'narration' END AS kind,
            {strip('''CASE WHEN t LIKE '“%' AND curly THEN trim(t, '“”') WHEN t LIKE '"%' AND NOT curly THEN trim(t, '"') ELSE t END''')} AS text FROM tok
    ), done AS (SELECT chapter_id, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY para, pos) - 1 AS INTEGER) AS id,
        CAST(para AS INTEGER) AS para, kind, text FROM seg WHERE text != '')"""
ORACLE["segments"] = _SEGMENTS + " SELECT chapter_id, id, para, kind, text FROM done"
ORACLE["segment_counts"] = _SEGMENTS + " SELECT chapter_id, kind, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS chars FROM done GROUP BY chapter_id, kind"


# ---- names in plain letters ----

_SHARES = f"""
    WITH {CAST}, p AS (SELECT book_id, id, name, notes, unnest(aliases) AS alias, aliases AS said FROM roster WHERE name IS NOT NULL),
    t AS (SELECT *, {ascii_tokens(ascii_of('name'))} AS own, {ascii_tokens(ascii_of('alias'))} AS words,
            flatten(list_transform(list_filter(said, lambda a: a IS NOT NULL AND a != alias), lambda a: {ascii_tokens(ascii_of('a'))})) AS others,
            {title_gender('alias')} AS g, coalesce({title_gender('name')}, ({note_genders('notes')})[1]) AS known FROM p WHERE alias IS NOT NULL)
    SELECT DISTINCT book_id, id, alias, len(words) > 0 AND NOT coalesce(g != known, false) AND (
        len(list_filter(words, lambda w: NOT list_contains(list_concat(own, others), w))) = 0
        OR (len(own) > 0 AND len(list_filter(own, lambda w: NOT list_contains(words, w))) = 0 AND list_contains(own, words[1]))) AS shares_name
    FROM t"""
ORACLE["shares_name"] = _SHARES
ORACLE["slugs"] = f"SELECT entry_id, {slug('name')} AS slug, {folded('name')} AS folded FROM cast_members WHERE name IS NOT NULL"
ORACLE["name_recognised"] = f"""
    SELECT pron_id, contains({folded('respelling')}, {folded('name')}) AS recognised FROM pronunciations WHERE name IS NOT NULL AND respelling IS NOT NULL"""
ORACLE["name_options"] = f"""
    SELECT book_id, name, CAST(row_number() OVER (PARTITION BY book_id, name ORDER BY encode(respelling)) AS INTEGER) AS option, respelling AS spoken_as,
        contains({folded("respelling || '. I said, ' || respelling || '.'")}, {folded('name')}) AS recognised
    FROM (SELECT DISTINCT book_id, name, respelling FROM pronunciations WHERE name IS NOT NULL AND respelling IS NOT NULL)"""

_W = r"\p{L}\p{N}_"
_SAFE = r"regexp_replace(name, '([^\p{L}\p{N}_])', chr(1) || '\\\1' || chr(1), 'g')"
# RE2 cannot look around: characters that are no letters stand between marks, so that names side by side share none.
_MARKED = "regexp_replace({t}, '([^" + _W + "])', chr(1) || '\\1' || chr(1), 'g')"
_PUT = (
    "replace(regexp_replace(" + _MARKED + ", CASE WHEN regexp_matches(e.name, '^[" + _W + "]') THEN '(^|' || chr(1) || ')' ELSE '([" + _W + "])' END || e.safe || "
    "CASE WHEN regexp_matches(e.name, '[" + _W + "]$') THEN '($|' || chr(1) || ')' ELSE '([" + _W + "])' END, '\\1' || replace(e.respelling, chr(92), chr(92) || chr(92)) || '\\2', 'g'), chr(1), '')"
)
ORACLE["respelled"] = rf"""
    WITH RECURSIVE lex AS (
        SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY length(name) DESC, ord, pron_id) AS place, {_SAFE} AS safe FROM (
            SELECT * FROM pronunciations WHERE name IS NOT NULL AND respelling IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY book_id, name ORDER BY loaded_at DESC, pron_id DESC) = 1) WHERE regexp_matches(name, '[{_W}]')
    ), held AS (
        SELECT s.seg_key, s.text, e.name, e.safe, e.respelling, row_number() OVER (PARTITION BY s.seg_key ORDER BY e.place) AS k
        FROM script_segments s JOIN lex e ON e.book_id = s.book_id AND contains(s.text, e.name)
    ), step AS (
        SELECT seg_key, text AS said, CAST(0 AS BIGINT) AS k FROM held WHERE k = 1
        UNION ALL
        SELECT p.seg_key, {_PUT.replace('{t}', 'p.said')}, e.k FROM step p JOIN held e ON e.seg_key = p.seg_key AND e.k = p.k + 1
    )
    SELECT f.seg_key, f.said AS spoken FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY seg_key ORDER BY k DESC) = 1) f
    JOIN script_segments s ON s.seg_key = f.seg_key WHERE f.said != s.text"""

# ---- casts and prompts ----

_LISTED = f"list_sort(list({{{{'ord': ord, 'entry_id': entry_id, 'line': concat_ws(' | ', id, coalesce(name, ''), coalesce(array_to_string(coalesce(aliases, []), ', '), ''))}}}}))".replace("{{", "{").replace("}}", "}")
_CASTS = f"casts AS (SELECT book_id, array_to_string(list_transform({_LISTED}, lambda m: m.line), chr(10)) AS listing FROM roster GROUP BY book_id)"
_LISTS = "ids AS (SELECT book_id, list(id ORDER BY ord, entry_id) AS l FROM roster GROUP BY book_id)"
ORACLE["cast_listing"] = f"""
    WITH {CAST}, few AS (SELECT * FROM roster WHERE ord % 5 != 0 AND NOT suffix(book_id, '7')),
    rows AS (SELECT book_id, list_sort(list({{'ord': ord, 'id': id, 'line': name || CASE WHEN array_to_string({texts('aliases')}, ', ') != ''
        THEN ' | ' || array_to_string({texts('aliases')}, ', ') ELSE '' END}})) AS r FROM few GROUP BY book_id)
    SELECT b.book_id, coalesce(array_to_string(list_transform(r, lambda x: x.line), chr(10)), '(empty)') AS listing
    FROM (SELECT DISTINCT book_id FROM books) b LEFT JOIN rows ON rows.book_id = b.book_id"""
ORACLE["merge_prompts"] = f"""
    WITH {CAST} SELECT book_id, id, concat_ws(' | ', id, coalesce(name, ''), coalesce(array_to_string({texts('aliases')}, ', '), ''),
        '[' || array_to_string(chapters[1:3], ', ') || ']', substr(coalesce(evidence[1], ''), 1, 80)) AS line FROM roster WHERE len(chapters) > 0"""


def _either(x: str, none: str) -> str:
    return f"CASE WHEN {x} != '' THEN {x} ELSE '{none}' END"


def _noted(kind: str) -> str:
    return _either(f"array_to_string(list_filter(coalesce(map_extract_value(notes, '{kind}'), []), lambda v: v IS NOT NULL), '/')", "?")


ORACLE["brief_prompts"] = f"""
    WITH {CAST}, todo AS (SELECT * FROM roster WHERE len(chapters) > 0 AND persona IS NULL)
    SELECT book_id, id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY len(chapters) DESC, ord, entry_id) AS INTEGER) AS place,
        md5(coalesce(name, '') || ' (' || id || '), also called ' || CASE WHEN len({texts('aliases')}) > 0 THEN array_to_string({texts('aliases')}, ', ') ELSE 'nothing else' END
        || '; speaks in ' || len(chapters) || ' chapters, some ' || coalesce(lines, 0) || ' lines, first in chapter ' || chapters[1] || '.' || chr(10)
        || 'Noted: gender ' || {_noted('gender')} || '; age ' || {_noted('age')} || '; origin ' || {_noted('origin')} || '; standing ' || {_noted('class')} || '. Disguises: '
        || CASE WHEN len({texts('disguises')}) > 0 THEN array_to_string({texts('disguises')}, ', ') ELSE 'none' END || '.' || chr(10)
        || {_either(f"array_to_string(({texts('evidence')})[1:40], chr(10))", '(no evidence)')}) AS body_md5 FROM todo"""

_ASKED = f"""{TEXTS}, {CAST}, {_CASTS}, {_BATCHED.format(source='texts', most=120)}, lined AS (
        SELECT *, CASE WHEN kind = 'quote' THEN '[Q' || id || '] "' || text || '"' ELSE text END AS line,
            coalesce(string_agg(text, ' ') OVER (PARTITION BY book_id, n ORDER BY id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), '') AS earlier
        FROM batched WHERE total > 0
    ), asked AS (SELECT book_id, n, batch, arg_min(earlier, id) AS earlier, string_agg(line, chr(10) ORDER BY id) AS body FROM lined GROUP BY book_id, n, batch)"""
ORACLE["label_prompts"] = f"""
    WITH {_ASKED} SELECT a.book_id, a.n, a.batch, md5(coalesce(c.listing, '(none)') || chr(10) || chr(10)
        || 'Say of each marked quotation which character speaks it, from what the narration tells and from the turns of the talk, and in which mood (one word). '
        || 'Where no character of the list fits, the speaker is "unknown".' || chr(10)
        || 'Answer with JSON alone: {{"quotes": {{"<number>": {{"speaker": "<id>", "emotion": "<mood>"}}}}}}' || chr(10) || chr(10)
        || CASE WHEN earlier != '' THEN '(Before this part: ...' || earlier || ')' || chr(10) || chr(10) ELSE '' END || body) AS prompt_md5
    FROM asked a LEFT JOIN casts c ON c.book_id = a.book_id"""
_WHO = "coalesce(l[id % len(l) + 1], 'unknown')"
ORACLE["label_batches"] = f"""
    WITH {TEXTS}, {CAST}, {_LISTS}
    SELECT s.book_id, s.n, s.id, CASE s.id % 3 WHEN 0 THEN '"' || {_WHO.replace('id %', 's.id %')} || '"'
        WHEN 1 THEN '{{"emotion":"calm","speaker":"' || {_WHO.replace('id %', 's.id %')} || '"}}' ELSE '{{"emotion":"","speaker":{{"id":"' || {_WHO.replace('id %', 's.id %')} || '"}}}}' END AS label
    FROM texts s LEFT JOIN ids ON ids.book_id = s.book_id WHERE s.kind = 'quote'"""

_LABELLED = """spoken AS (
    SELECT s.book_id, s.n, s.id, s.para, s.kind, s.text, CASE WHEN s.kind = 'quote' THEN coalesce(l[s.id % len(l) + 1], 'unknown') ELSE 'narrator' END AS speaker,
        CASE WHEN s.kind = 'quote' AND s.id % 3 = 1 THEN 'calm' ELSE 'neutral' END AS emotion, CAST(NULL AS BOOLEAN) AS tag_override
    FROM {source} s LEFT JOIN ids ON ids.book_id = s.book_id)"""
_OVER = TAGGED[len(SCRIPT) :].replace("FROM script WINDOW", "FROM spoken WINDOW")
ORACLE["attribute_chapters"] = f"""
    {_SEGMENTS}, {CAST.replace('roster AS', 'members AS')}, {_LISTS.replace('FROM roster', 'FROM members')},
    placed AS (SELECT c.book_id, d.chapter_id AS n, d.id, d.para, d.kind, d.text FROM done d JOIN chapters c ON c.chapter_id = d.chapter_id),
    {_LABELLED.format(source='placed')}{_OVER}
    SELECT n AS chapter_id, id, kind, speaker, emotion, now AS overridden_now FROM tagged"""
ORACLE["profile_scores"] = f"""
    WITH {TEXTS}, {CAST.replace('roster AS', 'members AS')}, {_LISTS.replace('FROM roster', 'FROM members')}, {_LABELLED.format(source='texts')}{_OVER}
    SELECT 'rule' AS profile, t.book_id, t.n, count(*) AS quotes, count(*) FILTER (g.speaker IS NOT DISTINCT FROM t.speaker AND NOT coalesce(t.tag_override, false)) AS model_only,
        count(*) FILTER (g.speaker IS NOT DISTINCT FROM t.speaker) AS with_tag_override
    FROM tagged t JOIN texts g ON g.book_id = t.book_id AND g.n = t.n AND g.id = t.id WHERE t.kind = 'quote' GROUP BY t.book_id, t.n"""

_NOTED = """last AS (SELECT book_id, n, text FROM chapters QUALIFY row_number() OVER (PARTITION BY book_id, n ORDER BY loaded_at DESC, chapter_id DESC) = 1)"""
ORACLE["collect_notes"] = f"""
    WITH {_NOTED} SELECT a.book_id, a.n, CAST(count(DISTINCT b.n % 7) AS INTEGER) AS known, CASE WHEN a.text IS NULL THEN 0 ELSE 1 END AS attempts
    FROM last a LEFT JOIN last b ON b.book_id = a.book_id AND b.n < a.n AND b.text IS NOT NULL GROUP BY a.book_id, a.n, a.text"""
ORACLE["collected_cast"] = f"""
    WITH {_NOTED}, r AS (SELECT book_id, n, 'Reader ' || 'ABCDEFG'[n % 7 + 1] || 'ora' AS name FROM last WHERE text IS NOT NULL)
    SELECT book_id, replace(lower(name), ' ', '_') AS id, name, CAST(count(*) FILTER (n % 2 = 0) AS INTEGER) AS chapters, CAST(coalesce(sum(n) FILTER (n % 2 = 0), 0) AS BIGINT) AS lines
    FROM r GROUP BY book_id, name"""

# ---- voices ----

_MAPPED = VOICES.replace("counts AS (", "all_counts AS (").replace("FROM counts c", "FROM stocked c") .replace("turns AS (", """speaking AS (
    SELECT c.*, r.name, c.lines >= 5 AND length(coalesce(r.name, '')) % 3 != 0 AS own FROM all_counts c JOIN roster r ON r.book_id = c.book_id AND r.id = c.speaker
), stocked AS (SELECT book_id, speaker, lines, f FROM speaking WHERE NOT own
), turns AS (""") + """, mapped AS (SELECT book_id, speaker, voice FROM voices UNION ALL SELECT book_id, speaker, speaker FROM speaking WHERE own)"""
_SPOKEN = SCRIPT.replace("script AS", "raw AS", 1) + ", script AS (SELECT * FROM raw WHERE text IS NOT NULL)"
ORACLE["voices_mapped"] = f"WITH {_SPOKEN}, {_MAPPED} SELECT book_id, speaker, voice FROM mapped"
_STOCK = ", ".join(f"('{k}', '{v}')" for k, v in vx.STOCK_SOUNDS.items())
_MADE = rf"""{_SPOKEN}, {_MAPPED}, {BOOKS}, {NARRATION}, best AS (
    SELECT book_id, speaker, text AS line FROM (SELECT *, length(text) BETWEEN 60 AND 220 AS good, regexp_matches(text, '[.!?]{_WS}*$') AS whole FROM spoken)
    QUALIFY row_number() OVER (PARTITION BY book_id, speaker ORDER BY CASE WHEN good THEN 0 ELSE 1 END, CASE WHEN good AND whole THEN 0 ELSE 1 END,
        CASE WHEN good THEN abs(length(text) - 140) ELSE -length(text) END, n, id) = 1
), made AS (
    SELECT s.book_id, s.speaker AS id, 'The voice of ' || coalesce(s.name, '') AS instruct, b.line FROM speaking s JOIN best b ON b.book_id = s.book_id AND b.speaker = s.speaker WHERE own
    UNION ALL SELECT DISTINCT m.book_id, k.id, k.instruct, '{vx.STOCK_LINE}' FROM mapped m JOIN (VALUES {_STOCK}) k(id, instruct) ON k.id = m.voice
    UNION ALL SELECT s.book_id, 'narrator', '{vx.NARRATOR_SOUND}', coalesce(t.line, '{vx.NO_NARRATION}')
        FROM (SELECT DISTINCT book_id FROM script) s LEFT JOIN narration t ON t.book_id = s.book_id
)"""
ORACLE["voices_made"] = f"WITH {_MADE} SELECT book_id, id, md5(instruct || '|' || line) AS voice_md5 FROM made"
ORACLE["reading_plan"] = f"""
    WITH {_SPOKEN}, {_MAPPED}, voiced AS (
        SELECT s.book_id, s.n, s.id, s.para, s.text, CASE WHEN s.kind = 'quote' THEN coalesce(v.voice, 'narrator') ELSE 'narrator' END AS voice
        FROM script s LEFT JOIN mapped v ON v.book_id = s.book_id AND v.speaker = s.speaker
    ), {chunked('voiced', 'book_id, n, id, para, voice')}, clips AS (
        SELECT book_id, n, id, para, voice, generate_subscripts(l, 1) AS chunk, unnest(l) AS piece FROM pieces
    ), gaps AS (
        SELECT *, CASE WHEN lag(id) OVER w IS NULL THEN 0.0 ELSE greatest(CASE WHEN lag(para) OVER w != para THEN 0.7 ELSE 0.25 END,
            CASE WHEN lag(voice) OVER w != voice THEN 0.4 ELSE 0 END) END AS pause
        FROM clips WINDOW w AS (PARTITION BY book_id, n ORDER BY id, chunk))
    SELECT book_id, n, voice, count(*) AS pieces, CAST(sum(floor(CAST(pause AS DOUBLE) * 24000)) AS BIGINT) AS silence FROM gaps GROUP BY book_id, n, voice"""
ORACLE["file_tags"] = f"""
    WITH {DURATIONS}, {INDEX}, {BOOKS}, t AS (
        SELECT d.book_id, d.n, coalesce(i.title, 'Chapter ' || d.n) AS title, coalesce(a.title, '') || ' (Full Cast)' AS album, coalesce(a.author, '') AS author
        FROM durations d LEFT JOIN idx i ON i.book_id = d.book_id AND i.n = d.n JOIN about a ON a.book_id = d.book_id)
    SELECT book_id, n, unnest(['title', 'album', 'artist', 'album_artist', 'genre', 'track']) AS tag,
        unnest([title, album, author, author, 'Audiobook', CAST(n AS VARCHAR)]) AS value FROM t"""
ORACLE["concat_listings"] = f"""
    WITH {DURATIONS} SELECT book_id, string_agg('file ' || chr(39) || '/out/' || book_id || '/' || lpad(CAST(n AS VARCHAR), 3, '0') || '.wav' || chr(39), chr(10) ORDER BY n) || chr(10) AS listing
    FROM durations GROUP BY book_id"""
