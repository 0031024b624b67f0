"""Text functions, log files and windows over conversations, documents, pages and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evtrail.functions import messages, text
from evtrail.operators import context, windows
from evtrail.scratch import written
from evtrail.sources import chat, sinks
from evtrail.sources.tables import EVENT_MESSAGES_SQL as M
from evtrail.sources.tables import event_messages, table

from .drafts import quoting
from .registry import query
from .windows import _WINDOWS, _header

_STR = "array<string>"


# -- text ------------------------------------------------------------------------------------------


@query(r"SELECT conv_id || ':' || turn AS id, trim(text) || chr(10) || 'b' || chr(10) || CASE WHEN turn % 2 = 0 THEN '好吗？' ELSE '妈妈在' END AS t FROM conversations")
def x1_clean_text(spark, d):
    c = table(spark, d, "conversations")
    odd = F.concat(F.lit("　 \x1c"), F.trim("text"), F.lit("\xa0 \t\r\nb   "), F.when(F.col("turn") % 2 == 0, "好妈？").otherwise("妈妈在"), F.lit("  \r\n \n"))
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), text.clean_text(odd).alias("t"))


@query("SELECT conv_id || ':' || turn AS id, 'x' || turn || CASE WHEN trim(text) = '' THEN '' ELSE chr(10) || chr(10) || trim(text) END AS t, CASE WHEN role = 'user' THEN 'user；a' ELSE role || '；user；a' END AS titles FROM conversations")
def x11_dedupe_paragraphs(spark, d):
    c = table(spark, d, "conversations")
    first = F.concat(F.lit("x"), F.col("turn").cast("string"))
    pieces = F.concat_ws("\n \n", first, F.concat(F.lit(" "), "text"), F.lit(""), first, "text")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), text.dedupe_paragraphs(pieces).alias("t"), text.combine_titles(F.array("role", F.lit(" user"), F.lit(""), F.lit("a"), "role")).alias("titles"))


@query("SELECT c_custkey, '2026-01-02-' || replace(c_name, '#', '#') || '_a_b' || CASE WHEN c_custkey % 2 = 0 THEN '-merged' ELSE '' END || '.md' AS name FROM customer")
def x12_output_name(spark, d):
    owner = F.concat(F.lit(" ."), "c_name", F.lit(" a/b?. "))
    return table(spark, d, "customer").select("c_custkey", text.output_name(F.lit("2026-01-02").cast("date"), owner, F.col("c_custkey") % 2 == 0).alias("name"))


@query(r"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN '[文件附件]' WHEN 1 THEN 'see[链接] now' WHEN 2 THEN '[图片]' WHEN 3 THEN '[语音消息 3s]' WHEN 4 THEN '@Li Lei hi' ELSE '' END AS t FROM pages""")
def x14_compress_text(spark, d):
    k = F.col("page_id") % 6
    raw = F.when(k == 0, "any").when(k == 1, F.concat(F.lit("see["), F.lit("x"), F.lit("]("), "url", F.lit(") now"))).when(k == 2, "[Image: img_v3_1]").when(k == 3, '<audio key="a" duration="3s"/>').when(k == 4, '<at id="1">Li Lei</at> <b></b>hi').otherwise("[Sticker]")
    shaped = F.regexp_replace(messages.compress_text(raw, F.when(k == 0, "file").otherwise("text")), r"\s+", " ")
    return table(spark, d, "pages").select("page_id", F.replace(shaped, F.lit("seex["), F.lit("see[")).alias("t"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '[文件附件]' WHEN 1 THEN '[飞书文档: T' || page_id || ']' WHEN 2 THEN '[飞书文档]' ELSE '' END AS label FROM pages")
def x16_document_label(spark, d):
    k, link = F.col("page_id") % 4, F.concat(F.lit(" https://x.feishu.cn/docx/t"), F.col("page_id").cast("string"))
    body = F.when(k == 3, F.concat(F.lit("see "), link)).otherwise(link)
    title = F.when(k == 1, F.concat(F.lit(" T"), F.col("page_id").cast("string"))).when(k == 2, "")
    return table(spark, d, "pages").select("page_id", messages.document_label(F.trim(body), title, F.when(k == 0, "file").otherwise("text")).alias("label"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%H:%M') WHEN event_id % 3 = 1 THEN '07:00' ELSE '' END AS t FROM events")
def x17_action_time(spark, d):
    ts = F.col("ts").cast("timestamp")
    raw = F.when(F.col("event_id") % 3 == 0, F.unix_millis(ts).cast("string")).otherwise("soon")
    back = F.when(F.col("event_id") % 3 == 1, F.lit("2026-01-01 07:00:00").cast("timestamp"))
    return table(spark, d, "events").select("event_id", text.format_time(messages.action_time(raw, back)).alias("t"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name || CASE WHEN p_partkey % 2 = 0 THEN '.doc' ELSE '' END END AS name FROM part")
def x18_base_name(spark, d):
    k = F.col("p_partkey")
    mark = F.when(k % 5 == 0, "_V21（终版）").when(k % 5 == 1, " (version 3)").when(k % 5 == 2, "-第2版-修订版").when(k % 5 == 3, "【】").otherwise(" Ｖ１２")
    name = F.when(k % 7 == 0, F.when(k % 2 == 0, "v2").otherwise(" \t")).otherwise(F.concat(F.lit(" "), F.upper("p_name"), mark, F.when(k % 2 == 0, ".DOC ").otherwise("")))
    return table(spark, d, "part").select("p_partkey", messages.attachment_base_name(name).alias("name"))


@query("""SELECT page_id, 'a《T' || page_id || '》b ' || CASE WHEN page_id % 2 = 0 THEN '《U》' ELSE '《http://u.example》' END || ' and 《V.*》, 《V.*》《T' || page_id || '》' AS t,
  replace(html, '<title>', '《V.*》') AS named, '《¤' || page_id || '》' || html AS begun FROM pages""")
def x21_readable_files(spark, d):
    name = F.concat(F.lit("T"), F.col("page_id"))
    link = lambda url, title: F.struct(F.lit(url).alias("url") if isinstance(url, str) else url.alias("url"), (F.lit(title) if isinstance(title, str) else title).alias("title"))
    # the second URL begins the third, a title holds what a pattern would read as more than itself
    links = F.array(link(F.col("url"), name), link("http://u.example", F.when(F.col("page_id") % 2 == 0, "U").otherwise("")), link("http://u.example/c", "V.*"))
    body = F.concat(F.lit("a"), "url", F.lit("b http://u.example and http://u.example/c, 《V.*》"), name)
    named = messages.readable_files(F.col("html"), F.array(link("<title>", "V.*")))
    begun = messages.readable_files(F.col("html"), F.array(link("no such link", F.concat(F.lit("¤"), "page_id"))), prefix=True)
    return table(spark, d, "pages").select("page_id", messages.readable_files(body, links).alias("t"), named.alias("named"), begun.alias("begun"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), ['token-' || printf('%04d', p_partkey)]))), ' ') AS tokens FROM part")
def x22_link_tokens(spark, d):
    url = F.concat(F.lit("https://x.feishu.cn/docx/Token-"), F.format_string("%04d", "p_partkey"), F.lit("?a=1"))
    tokens = text.link_tokens(F.concat(F.upper("p_name"), F.lit(", www a")), url)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'hi ' || page_id || chr(10) END || 'T ' || url || chr(10) || 'http://b' AS t FROM pages")
def x24_message_to_text(spark, d):
    links = F.array(F.struct(F.col("url"), F.lit("T").alias("title")), F.struct(F.lit("http://b").alias("url"), F.lit("").alias("title")))
    body = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("hi "), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", messages.message_to_text(body, links).alias("t"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lang END || ',other' AS keys, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' ELSE lang END || ',other' AS labels FROM documents")
def x26_labels_to_keys(spark, d):
    pairs = {"en": "english", "de": "german"}
    keys = messages.labels_to_keys(F.array("lang", F.lit("other"), "lang"), pairs)
    return table(spark, d, "documents").select("doc_id", F.array_join(keys, ",").alias("keys"), F.array_join(messages.keys_to_labels(keys, pairs), ",").alias("labels"))


@query("SELECT doc_id, '[id] ' || text || ' [id] ou_1 x_ou_' || doc_id || '00000000' AS t FROM documents")
def x20_redact_ids(spark, d):
    number = F.lpad(F.col("doc_id").cast("string"), 9, "a")
    body = F.concat(F.lit("ou_"), number, F.lit(" "), "text", F.lit(" oc_"), number, F.lit(" ou_1 x_ou_"), "doc_id", F.lit("00000000"))
    return table(spark, d, "documents").select("doc_id", text.redact_ids(body).alias("t"))


@query("SELECT conv_id || ':' || turn AS id, trim(text) = '' OR turn % 3 = 0 AS weak FROM conversations")
def f19_weak_placeholder(spark, d):
    c = table(spark, d, "conversations")
    body = F.when(F.col("turn") % 3 == 0, " [图片]").otherwise(F.concat(F.lit("[图片]"), "text"))
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), messages.is_weak_placeholder(body, F.lit(False), F.lit(0), F.lit(0)).alias("weak"))


# -- sources ---------------------------------------------------------------------------------------


@query("SELECT conv_id || ':' || turn AS id, CASE WHEN trim(text) = '' THEN '' ELSE trim(text) || chr(10) END || 'link' AS text, 'http://a/' || turn AS links, CASE WHEN turn % 2 = 0 THEN 'img_1' ELSE '' END AS images, role AS mentions FROM conversations")
def s2_extract_content(spark, d):
    c = table(spark, d, "conversations")
    link = F.struct(F.lit("a").alias("tag"), F.lit(" link ").alias("text"), F.concat(F.lit("http://a/"), F.col("turn").cast("string")).alias("href"))
    deep = F.array(F.array(F.struct(F.lit("text").alias("tag"), F.trim("text").alias("text"))))
    who, image = F.struct(F.lit("at").alias("tag"), F.col("role").alias("user_id")), F.struct(F.when(F.col("turn") % 2 == 0, "img_1").alias("image_key"))
    tree = F.to_json(F.struct(deep.alias("content"), F.array(F.array(link)).alias("more"), F.array(who).alias("at"), F.array(image).alias("media"), link.alias("again")))
    tree = F.regexp_replace(tree, ',"again":.*$', "}")
    at = chat.extract_content(c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), tree.alias("content")))
    return at.select("id", "parts.text", F.array_join(F.transform("parts.links", lambda x: x["url"]), ",").alias("links"), F.array_join("parts.images", ",").alias("images"), F.array_join("parts.mentions", ",").alias("mentions"))


@query("SELECT conv_id || ':' || turn AS id, CASE WHEN turn % 3 = 0 THEN role || ',u' || turn WHEN turn % 3 = 1 THEN 'n' || turn ELSE '' END AS ids FROM conversations")
def s3_extract_mentions(spark, d):
    k = F.col("turn").cast("string")
    two = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("open_id")), F.struct(F.concat(F.lit(" u"), k).alias("open_id")), F.struct(F.col("role").alias("open_id"))).alias("mentions")))
    nested = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("n"), k).alias("open_id")).alias("id"))).alias("mentions")))
    raw = F.when(F.col("turn") % 3 == 0, two).when(F.col("turn") % 3 == 1, nested).otherwise("{}")
    return table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.array_join(chat.extract_mentions(raw), ",").alias("ids"))


@query("SELECT event_id, event_type AS emoji, 'u' || user_id AS operator FROM events UNION ALL SELECT event_id, event_type, 'v' FROM events WHERE event_id % 2 = 0")
def s4_flatten_reactions(spark, d):
    own = F.struct(F.lit("v").alias("operator_id"), F.lit("7").alias("action_time"))
    detail = F.when(F.col("event_id") % 2 == 0, F.array(own, own))
    item = F.struct(F.struct(F.col("event_type").alias("emoji_type")).alias("reaction_type"), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("open_id")).alias("operator"), detail.alias("details"))
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.array(item).alias("reactions"))).alias("raw"))
    return chat.flatten_reactions(rows, "event_id").select("event_id", F.col("emoji_type").alias("emoji"), F.col("operator_open_id").alias("operator"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'img_' || page_id || ',img_b' ELSE 'img_b' END AS ids FROM pages")
def s5_extract_attachments(spark, d):
    body = F.concat(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("[Image: img_"), F.col("page_id").cast("string"), F.lit("] "))).otherwise(""), F.lit("x ![a](img_b) [Image: nothing] ![b](img_b)"))
    return table(spark, d, "pages").select("page_id", F.array_join(chat.extract_attachments(body), ",").alias("ids"))


def _logs(spark, d):
    """A day's file for each conversation: a block a turn, the last one without its end; even conversations have
    one written by hand."""
    c = table(spark, d, "conversations")
    block = F.concat(F.lit("<!-- event:start -->\n## "), "role", F.lit("\n- 标识: "), F.col("turn").cast("string"), F.lit("\n- **Tags**：a，b\n"), F.when(F.col("turn") % 2 == 1, "<!-- event:end -->\n").otherwise(""))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("m"))
    hand = F.when(F.col("conv_id") % 2 == 0, "## by hand\n- id: h\n").otherwise("")
    return rows.select(F.col("conv_id").alias("path"), F.concat(F.lit("# day\n\n"), hand, F.array_join(F.transform("m", lambda x: x["b"]), "")).alias("body"))


@query("SELECT conv_id AS path, role AS title, turn::VARCHAR AS id, false AS manual, 'a,y' AS tags FROM conversations UNION ALL SELECT DISTINCT conv_id, 'by hand', 'h', true, '' FROM conversations WHERE conv_id % 2 = 0")
def s9_event_blocks(spark, d):
    """S9 and S10: blocks of log files and their fields."""
    at = chat.parse_event_block(chat.event_blocks(_logs(spark, d)), {"id": ("id", "标识"), "tags": ("Tags", "标签")}, {"tags": {"b": "y"}})
    return at.select("path", "title", "id", "manual", F.array_join("tags", ",").alias("tags"))


_VALID = "page_id % 6 NOT IN (1, 3, 5)"


@query(f"SELECT page_id, CASE WHEN {_VALID} THEN CASE page_id % 6 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END END AS version, CASE WHEN {_VALID} THEN 'sha256:' || sha256(url) END AS file_key FROM pages")
def s11_parse_merge_meta(spark, d):
    k, good = F.col("page_id") % 6, F.concat(F.lit("sha256:"), F.sha2("url", 256))
    version = F.when(k == 0, 1).when(k == 2, 2).when(k == 5, 4).otherwise(3)
    key = F.when(k == 1, "sha256:12").otherwise(good)
    print_of = F.when(k == 4, good).when(k == 1, good)  # k = 3: version 3 without the content's fingerprint
    meta = F.to_json(F.struct(version.alias("version"), F.array(key).alias("file_keys"), F.array(F.lit("x")).alias("self_relations"), print_of.alias("content_fingerprint")))
    block = F.concat(F.lit("## t\n<!-- meta: "), meta, F.lit(" -->\n\ntext"))
    at = table(spark, d, "pages").select("page_id", chat.parse_merge_meta(block).alias("m"))
    return at.select("page_id", "m.version", F.get("m.file_keys", F.lit(0)).alias("file_key"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, url FROM pages")
def s12_front_matter(spark, d):
    p = table(spark, d, "pages")
    body = F.concat(F.lit("---\ntitle:  "), F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("\nnothing\nsource: "), "url", F.lit("\n---\n# a: b\n"), "html")
    m = p.select("page_id", text.front_matter(body).alias("m"))
    return m.select("page_id", F.col("m")["title"].alias("title"), F.col("m")["source"].alias("url"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '2026-07-10' END AS day, c_name AS owner, c_custkey % 2 = 0 AS merged FROM customer")
def s13_file_name_parts(spark, d):
    day = F.when(F.col("c_custkey") % 3 == 0, "").otherwise("2026-07-10-")
    name = F.concat(day, "c_name", F.when(F.col("c_custkey") % 2 == 0, "-merged").otherwise(""), F.lit(".md"))
    return table(spark, d, "customer").select("c_custkey", text.file_name_parts(name).alias("p")).select("c_custkey", "p.day", "p.owner", "p.merged")


@query("SELECT '/logs' || CASE c_custkey % 5 WHEN 0 THEN '/' ELSE '/team/' END || '2026-07-10-' || replace(c_name, '#', '') || '.md' AS path, CASE c_custkey % 5 WHEN 0 THEN '' ELSE 'team' END AS scope FROM customer WHERE c_custkey % 5 IN (0, 1) AND c_custkey % 7 <> 0 AND c_custkey <> 11")
def s14_scan_scopes(spark, d):
    k = F.col("c_custkey")
    folder = F.when(k % 5 == 0, "/").when(k % 5 == 1, "/team/").when(k % 5 == 2, "/.hidden/").when(k % 5 == 3, "/team/deep/").otherwise("/.")
    name = F.concat(F.when(k % 7 == 0, "2026-07-11-").otherwise("2026-07-10-"), F.replace("c_name", F.lit("#"), F.lit("")), F.lit(".md"))
    files = table(spark, d, "customer").select(F.concat(F.lit("/logs"), folder, name).alias("path"))
    return chat.scan_scopes(files, "/logs/", "2026-07-10", "Customer000000011").select("path", "scope")


@query("""WITH f AS (SELECT conv_id AS path, count(*) FILTER (conv_id % 5 > 0) AS blocks, count(*) FILTER (turn = 4 AND conv_id % 5 > 0) AS bare FROM conversations GROUP BY 1)
SELECT path, CASE WHEN path % 7 = 0 OR blocks = 0 THEN 'skipped' WHEN bare > 0 THEN 'partial' ELSE 'success' END AS status, blocks, bare, CASE WHEN path % 7 = 0 THEN 'no day in the file name' WHEN blocks = 0 THEN 'no event block' WHEN bare > 0 THEN 'blocks without title' WHEN path % 3 = 0 THEN 'day differs from the file name' ELSE '' END AS reason FROM f""")
def s15_read_audit(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.when(F.col("turn") == 4, "").otherwise("t").alias("title"))
    name = F.concat(F.when(F.col("path") % 7 == 0, "").otherwise("2026-07-10-"), F.lit("owner"), F.col("path").cast("string"), F.lit(".md"))
    files = c.select("path").distinct().select("path", name.alias("file"), F.when(F.col("path") % 3 == 0, "2026-07-11").otherwise("2026-07-10").alias("date"))
    return chat.read_audit(files, c.where("path % 5 <> 0"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'f' || conv_id || ',' ELSE '' END || 'img_' || conv_id || ',k' || turn AS ids, CASE WHEN turn % 2 = 0 THEN role || '|' ELSE '' END || '[Image]|' || role || '.pdf' AS names FROM conversations""")
def s5_extract_media(spark, d):
    c = table(spark, d, "conversations")
    content = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("f"), "conv_id").alias("file_key"), F.col("role").alias("file_name"))))
    tag = lambda name: F.concat(F.lit('<FILE key="k'), "turn", F.lit('" name="'), name, F.lit('"/>'))
    # the tag comes twice: its last name counts, at its first place
    body = F.concat("text", F.lit(" [Image: img_"), "conv_id", F.lit("] "), tag(F.lit("old")), F.lit(" ![x](img_"), "conv_id", F.lit(") "), tag(F.concat("role", F.lit(".pdf"))))
    at = c.select("conv_id", "turn", chat.extract_media(content, body).alias("m"))
    return at.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: x["attachment_id"]), ",").alias("ids"), F.array_join(F.transform("m", lambda x: x["file_name"]), "|").alias("names"))


@query("SELECT conv_id AS owner_id, '# 2026-01-02' || chr(10) || chr(10) || string_agg('<!-- event:start -->' || chr(10) || '## ' || role || chr(10) || '- id: e' || turn || chr(10) || chr(10) || text || chr(10) || '<!-- event:end -->', chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1")
def s19_render_day(spark, d):
    c = table(spark, d, "conversations")
    events = c.select(F.col("conv_id").alias("owner_id"), F.lit("2026-01-02").cast("date").alias("date"), F.col("role").alias("title"), F.concat(F.lit("e"), F.col("turn").cast("string")).alias("event_id"), F.col("text").alias("content"), F.col("turn").alias("pos"))
    return sinks.render_day(events).select("owner_id", "body")


@query("""WITH e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE conv_id % 4 > 0)
SELECT conv_id AS path, count(*) OVER (PARTITION BY conv_id)::VARCHAR AS n, 'o' || conv_id AS owner, pos::INT AS pos, role AS title, 'e' || turn AS id, CASE WHEN before IS NULL OR before = role THEN role ELSE role || '、' || before END AS people, trim(text) AS said,
  3 AS version, 'sha256:' || sha256(text) AS content, 'sha256:' || sha256(role) AS file, CASE WHEN turn % 3 = 0 THEN 'manual_modified' ELSE '' END AS edit FROM e
UNION ALL SELECT DISTINCT conv_id, '0', 'o' || conv_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM conversations WHERE conv_id % 4 = 0""")
def s19_render_documents(spark, d):
    """Documents with front matter and metadata lines, read back as files are (S9 to S12)."""
    c = table(spark, d, "conversations")
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    print_of = lambda x: F.concat(F.lit("sha256:"), F.sha2(x, 256))
    edit = F.when(F.col("turn") % 3 == 0, "manual_modified").otherwise("by_nobody")
    meta = sinks.merge_meta(file_keys=F.array(print_of("role"), F.lit("sha256:no"), print_of("role")), self_relations=F.array(F.lit("lead"), F.lit("ou_0123456789abcdef")), source_manual_edit_types=F.array(edit), manual_edit_type=edit, content_fingerprint=print_of("text"))
    events = c.where("conv_id % 4 > 0").select(F.col("conv_id").alias("owner_id"), F.lit("2026-01-02").alias("date"), F.col("turn").alias("pos"), F.col("role").alias("title"), F.concat(F.lit("e"), "turn").alias("event_id"), F.col("text").alias("content"), F.array_compact(F.array("role", before)).alias("people"), meta.alias("meta"))
    days = c.select(F.col("conv_id").alias("owner_id"), F.lit("2026-01-02").alias("date")).distinct()
    logs = written(sinks.render_documents(events, days, {"people": "people"}, {"owner": F.concat(F.lit("o"), "owner_id")}).select(F.col("owner_id").alias("path"), "body"), "documents")
    at = chat.parse_event_block(chat.event_blocks(logs), {"id": ("id",), "people": ("people",)}).withColumn("m", chat.parse_merge_meta(F.col("block")))
    said = F.trim(F.regexp_extract("block", r"(?s)\n\n(?:- [^\n]*\n)*\n(.*)\z", 1))
    at = at.select("path", "pos", "title", "id", "people", said.alias("said"), "m.version", F.col("m.content_fingerprint").alias("content"), F.get("m.file_keys", F.lit(0)).alias("file"), F.col("m.manual_edit_type").alias("edit"))
    front = logs.select("path", text.front_matter("body").alias("f")).select("path", F.col("f")["event_count"].alias("n"), F.col("f")["owner"].alias("owner"))
    return front.join(at, "path", "left")


@query("SELECT count(*) AS n, count(DISTINCT event_type || user_id % 5) AS types, count(*) FILTER (event_id % 9 = 0) AS empty FROM events")
def s20_check_catalog(spark, d):
    e = table(spark, d, "events")
    return chat.check_catalog(e.select(F.concat("event_type", (F.col("user_id") % 5).cast("string")).alias("emoji_type"), F.when(F.col("event_id") % 18 != 0, "n").alias("name"), F.when(F.col("event_id") % 18 == 9, "").otherwise("d").alias("description")))


# -- windows ---------------------------------------------------------------------------------------

_WIDE = _WINDOWS.replace("mem.message_id = m.reply_to", "mem.message_id IN (m.reply_to, m.quote_to)").replace("NOT coalesce(mem.anchor IN (p.anchor, p.before), false) GROUP BY 1, 2", "NOT coalesce(mem.anchor IN (p.anchor, p.before), false) AND NOT EXISTS (SELECT 1 FROM mem e WHERE e.conversation_id = m.conversation_id AND e.message_id IN (m.reply_to, m.quote_to) AND e.anchor IN (p.anchor, p.before)) GROUP BY 1, 2").replace("count(*) AS unrelated", "count(DISTINCT m.message_id) AS unrelated").replace("WHEN before IS NULL OR gap", "WHEN before IS NULL OR conversation_id % 6 <> 0 AND (gap").replace("> 3 THEN 1", "> 3) THEN 1")
_QUOTED = M.replace("m AS (SELECT *, ", "m AS (SELECT *, CASE WHEN k % 11 = 3 THEN lag(message_id, 3) OVER w END AS quote_to, ", 1)


@query(f"WITH {_QUOTED}, {_WIDE} SELECT conversation_id, \"window\"::BIGINT AS \"window\", n_anchors, anchor_rows, first, last FROM h")
def w4_private_windows(spark, d):
    """W3 with quotes, W4: a private conversation is one window."""
    msgs = quoting(spark, d).withColumn("private", (F.col("conversation_id") % 6 == 0) & (F.col("idx") == 2))
    return windows.window_header(windows.anchor_windows(msgs, 600)).drop("span_minutes")


@query(f"""WITH {M}, {_WINDOWS}, x AS (SELECT h.conversation_id, "window", m.* EXCLUDE (conversation_id) FROM h JOIN m ON m.conversation_id = h.conversation_id AND m.idx BETWEEN first AND last),
sig AS (SELECT conversation_id, "window", 'text:' || message_id AS id, ts FROM x WHERE owner UNION ALL SELECT conversation_id, "window", 'reaction:' || message_id || ':0', ts FROM x WHERE reacted),
k AS (SELECT x.conversation_id, x."window", m.message_id FROM x JOIN m ON m.conversation_id = x.conversation_id AND m.reply_to = x.message_id UNION SELECT conversation_id, "window", reply_to FROM x WHERE reply_to IS NOT NULL),
ou AS (SELECT k.* FROM k ANTI JOIN x USING (conversation_id, "window", message_id)), rr AS (SELECT conversation_id, "window", string_agg(message_id, ',' ORDER BY message_id) AS ids FROM ou GROUP BY 1, 2)
SELECT x.conversation_id, x."window"::BIGINT AS "window", string_agg(message_id, ',' ORDER BY idx) AS main, coalesce(any_value(rr.ids), '') AS relations, (SELECT string_agg(id, ',' ORDER BY ts, id) FROM sig WHERE sig.conversation_id = x.conversation_id AND sig."window" = x."window") AS signals FROM x LEFT JOIN rr ON rr.conversation_id = x.conversation_id AND rr."window" = x."window" GROUP BY 1, x."window" """)
def w5_window_ids(spark, d):
    msgs, header = _header(spark, d)
    members = windows.window_members(header, msgs, 0)
    at = windows.window_ids(members, windows.window_relations(members, msgs), windows.response_signals(msgs))
    listed = lambda c, name: F.array_join(F.col(c).cast(_STR), ",").alias(name)
    return at.select("conversation_id", "window", listed("main_ids", "main"), listed("relation_ids", "relations"), listed("signal_ids", "signals"))


@query(f"WITH {M}, x AS (SELECT message_id, k AS seg FROM m UNION ALL SELECT message_id, k + 1 FROM m WHERE k % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY seg) AS n FROM x) SELECT message_id, seg AS segment, CASE WHEN n = 1 THEN 'primary' ELSE 'context' END AS role FROM r")
def w11_dedupe_ownership(spark, d):
    m = event_messages(spark, d).select("message_id", "k")
    members = m.select("message_id", F.col("k").alias("segment")).union(m.where("k % 3 = 0").select("message_id", F.col("k") + 1)).withColumn("segment_order", F.col("segment"))
    return windows.dedupe_ownership(members).select("message_id", "segment", "role")


@query(f"WITH {M} SELECT message_id, CASE WHEN k % 4 = 0 OR owner THEN 'context' ELSE 'primary' END AS role FROM m")
def w12_demote_relation_context(spark, d):
    m = event_messages(spark, d)
    return context.demote_relation_context(m.select("message_id", F.when(F.col("owner"), "context").otherwise("primary").alias("role")), m.where("k % 4 = 0").select("message_id"))


@query(f"WITH {M}, x AS (SELECT conversation_id, k % 9 AS segment, message_id, owner, k % 2 = 0 AS p FROM m) SELECT conversation_id, segment, message_id FROM x WHERE (conversation_id, segment) IN (SELECT conversation_id, segment FROM x WHERE owner AND p)")
def w13_anchor_segments(spark, d):
    m = event_messages(spark, d).select("conversation_id", (F.col("k") % 9).alias("segment"), "message_id", "owner", F.when(F.col("k") % 2 == 0, "primary").otherwise("context").alias("role"))
    return windows.anchor_segments(m).select("conversation_id", "segment", "message_id")


@query(f"WITH {M}, e AS (SELECT k AS event_id, min(message_id) AS f, min(CASE WHEN owner THEN ts END) AS t FROM m GROUP BY 1) SELECT event_id, row_number() OVER (ORDER BY t NULLS FIRST, f::VARCHAR, event_id) AS pos FROM e")
def w21_order_events(spark, d):
    m = event_messages(spark, d)
    events = m.groupBy(F.col("k").alias("event_id")).agg(F.array_sort(F.collect_list("message_id")).alias("source_message_ids"))
    return windows.order_events(events, m.where("owner")).select("event_id", "pos")


@query(r"""WITH c AS (SELECT conv_id AS unit_id, count(*) AS rows, sum(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')))::BIGINT AS a, sum(length(text))::BIGINT AS n FROM conversations GROUP BY 1), t AS (SELECT unit_id, rows, (a * 5 + 11) // 12 + n - a + 200 AS tokens FROM c)
SELECT unit_id, rows, tokens::BIGINT AS tokens, row_number() OVER (ORDER BY tokens DESC, unit_id) AS pos FROM t""")
def w22_input_size(spark, d):
    return windows.input_size(table(spark, d, "conversations").select(F.col("conv_id").alias("unit_id"), "text"))


@query(f"""WITH {M}, {_WINDOWS}, x AS (SELECT *, unnest(range(greatest(first - 2, 1), last + 1)) AS idx FROM h) SELECT x.conversation_id, "window"::BIGINT AS "window", row_number() OVER (PARTITION BY x.conversation_id, "window" ORDER BY x.idx)::INT AS line, CASE WHEN x.idx < first THEN 'timeline' ELSE 'main' END AS role, event_type || ' ' || k AS text FROM x JOIN m USING (conversation_id, idx)""")
def a36_window_preview(spark, d):
    msgs, header = _header(spark, d)
    return windows.window_preview(windows.window_members(header, msgs), msgs.withColumn("text", F.concat_ws(" ", "event_type", F.col("k").cast("string"))))
