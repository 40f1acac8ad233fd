"""Shared pieces of the SQL twins (DuckDB spelling)."""

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
# White space as in the Spark side, spelled out because RE2 knows only the ASCII part.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2764}\x{2B50}\x{2B55}\x{1F000}-\x{1F0FF}\p{So}]"
OPENERS = ("'who','what','when','where','why','how','which','can','could','should','would','is','are','do','does',"
           "'did','will','any','anyone'")

ATTACHMENT = f"""CASE {K} % 8
    WHEN 0 THEN 'IMG-20240101-WA' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.jpg'
    WHEN 1 THEN 'VID-20240101-WA' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.mp4'
    WHEN 2 THEN 'PTT-20240101-WA' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.opus'
    WHEN 3 THEN 'STK-20240101-WA' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.webp'
    WHEN 4 THEN 'DOC-20240101-WA' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.pdf'
    WHEN 5 THEN lpad(CAST(event_id AS VARCHAR), 9, '0') || '-PHOTO-2024-01-01.jpg'
    WHEN 6 THEN 'contact ' || event_id || '.vcf'
    ELSE 'archive-' || event_id || '.xyz' END"""
KIND = f"""CASE {K} % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'voice' WHEN 3 THEN 'sticker'
    WHEN 4 THEN 'document' WHEN 5 THEN 'image' WHEN 6 THEN 'contact' ELSE 'other' END"""

RAW_E = f"""raw AS (
    SELECT CAST(user_id % 10 AS INT) AS archive_id, event_id AS line_no, ts, 'user ' || user_id AS sender,
           CASE event_type WHEN 'signup' THEN 'media' WHEN 'error' THEN 'deleted' ELSE 'text' END AS msg_type,
           (CASE event_type WHEN 'view' THEN 'what' ELSE event_type END) || ' ' || props AS text,
           CASE WHEN event_type = 'signup' THEN {ATTACHMENT} END AS attachment, {K} AS k, value,
           CASE WHEN event_type = 'signup' THEN {KIND} END AS kind
    FROM events)"""
RAW_C = """raw AS (
    SELECT 0 AS archive_id, conv_id * 1000 + turn AS line_no,
           TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 360 + turn * 7 AS BIGINT)) AS ts,
           role AS sender, CASE WHEN role = 'system' THEN 'system' ELSE 'text' END AS msg_type, text,
           CAST(NULL AS VARCHAR) AS attachment FROM conversations)"""


def raw_docs(sender: str) -> str:
    return f"""raw AS (
    SELECT 0 AS archive_id, doc_id AS line_no,
           TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 17 + (doc_id // 25) * 300 AS BIGINT)) AS ts,
           {sender} AS sender, 'text' AS msg_type, text, CAST(NULL AS VARCHAR) AS attachment FROM documents)"""


RAW_P = """raw AS (
    SELECT 0 AS archive_id, page_id AS line_no,
           TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id AS BIGINT)) AS ts,
           regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS sender, 'text' AS msg_type,
           CASE WHEN url LIKE 'https%' THEN 'see ' || url ELSE regexp_replace(url, '^.*://', '') END AS text,
           CAST(NULL AS VARCHAR) AS attachment FROM pages)"""


def word_count(col: str = "text") -> str:
    return f"CAST(len(regexp_extract_all({col}, '[^{SPACE}]+')) AS INT)"


def stripped(col: str = "text") -> str:
    return f"regexp_replace({col}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def question(col: str = "text") -> str:
    s = stripped(col)
    return f"(contains({s}, '?') OR lower(split_part({s}, ' ', 1)) IN ({OPENERS}))"


def messages(raw: str, gap: float, carry: str = "") -> str:
    """WITH clause whose last table ``m`` is the enriched stream of ``raw``."""
    return f"""WITH {raw},
o AS (SELECT *, 'name:' || lower(sender) AS pid, row_number() OVER w - 1 AS msg_id, lag(ts) OVER w AS pts,
             lag('name:' || lower(sender)) OVER w AS ppid
      FROM raw WHERE msg_type <> 'system' WINDOW w AS (PARTITION BY archive_id ORDER BY ts, line_no)),
g AS (SELECT *, CAST(epoch_us(ts) - epoch_us(pts) AS DOUBLE) / 1000000 AS gap FROM o),
s AS (SELECT *, (gap IS NULL OR gap > {gap} * 3600) AS is_start FROM g),
m AS (SELECT *, CAST(ts AS DATE) AS d, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday,
             strftime(ts, '%Y-%m') AS year_month, length(text) AS char_count, {word_count()} AS word_count,
             len(regexp_extract_all(text, '{EMOJI}')) AS emoji_count,
             regexp_matches(text, 'https?://\\S+|www\\.\\S+') AS has_url,
             CASE WHEN msg_type = 'text' THEN {question()} ELSE false END AS is_question,
             CAST(sum(CAST(is_start AS INT)) OVER (PARTITION BY archive_id ORDER BY ts, line_no
                  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id,
             CASE WHEN NOT is_start AND ppid IS DISTINCT FROM pid THEN gap END AS reply
      FROM s)
"""


E = messages(RAW_E, 1.0)
C = messages(RAW_C, 4.0)
DM = messages(raw_docs("source"), 4.0)
DL = messages(raw_docs("lang"), 4.0)
P = messages(RAW_P, 4.0)

# Files of the events chats and the media rows they lead to. Names are unique per archive.
_EV = f"ev AS (SELECT *, {K} AS k, {ATTACHMENT} AS name, {KIND} AS kind FROM events)"
FILES = f"""{_EV},
files AS (
    SELECT CAST(user_id % 10 AS INT) AS archive_id, event_id, 'media/' || stored AS path,
           regexp_extract(stored, '([^/]+)$', 1) AS filename, lower(regexp_extract(stored, '(\\.[^.]+)$', 1)) AS ext,
           fkind AS kind, CAST(k AS BIGINT) * 3000000 AS size_bytes,
           sha256(event_type || ' ' || k) AS content_hash, event_type = 'signup' AS linked, k, name
    FROM (SELECT *, kind AS fkind, CASE WHEN k < 30 THEN upper(name) WHEN k < 50 THEN 'sub/' || name
                         WHEN k < 70 THEN replace(name, '.opus', '.ogg') ELSE name END AS stored
          FROM ev WHERE event_type = 'signup' AND k >= 10
          UNION ALL
          SELECT *, 'image', 'extra-' || event_id || '.png' FROM ev WHERE event_type = 'purchase' AND k >= 95))"""
MEDIA = f"""{FILES},
bare AS (
    SELECT m.archive_id, row_number() OVER (PARTITION BY m.archive_id ORDER BY m.msg_id) - 1 AS media_id, m.msg_id,
           f.filename, f.path, f.kind, f.ext, f.size_bytes, f.content_hash, f.kind <> 'other' AS readable,
           m.ts, m.d, m.sender, m.text AS caption, f.k
    FROM m JOIN files f ON f.linked AND f.archive_id = m.archive_id AND f.event_id = m.line_no),
media AS (
    SELECT *, CASE WHEN readable AND k < 30 THEN 'known ' || k WHEN kind = 'video' AND size_bytes > 209715200 THEN NULL
                   WHEN readable AND kind <> 'document' THEN 'a ' || kind END AS description,
           CASE WHEN readable AND k < 30 THEN 'text ' || k END AS ocr_text,
           CASE WHEN NOT readable OR (k >= 30 AND kind = 'video' AND size_bytes > 209715200) THEN 'skipped' WHEN k < 30 OR kind <> 'document' THEN 'done' ELSE 'error' END AS status
    FROM bare)"""
E_MEDIA = E.rstrip() + ",\n" + MEDIA
CONTENT = E_MEDIA + """,
content AS (
    SELECT m.*, md.media_id, md.kind AS mkind, md.description, md.ocr_text,
           CASE WHEN md.media_id IS NULL THEN
                CASE WHEN m.msg_type = 'media' AND m.text = '' THEN '[attachment, not included in the export]'
                     WHEN m.msg_type = 'deleted' THEN '[message deleted]' ELSE m.text END
           ELSE trim(m.text || CASE WHEN coalesce(md.description, '') <> '' THEN ' [' || md.kind || ': ' || md.description || ']'
                                    ELSE ' [' || md.kind || ' sent, not yet described]' END
                            || CASE WHEN coalesce(md.ocr_text, '') <> '' THEN ' [text in image: ' || md.ocr_text || ']' ELSE '' END)
           END AS content
    FROM m LEFT JOIN media md ON md.archive_id = m.archive_id AND md.msg_id = m.msg_id)
"""


def contains_any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w.lower()}')" for w in words) + ")"


def top(body: str, k: int, order: str, cols: str = "*") -> str:
    """Rank filter per archive over a subquery."""
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY {order}) AS rank "
            f"FROM ({body})) WHERE rank <= {k}")
