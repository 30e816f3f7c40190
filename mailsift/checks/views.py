"""Mail-shaped views over the given tables.

Each text is one SQL statement that both Spark and DuckDB run; base tables appear as
``{name}``. Attributes are spread over the rows with CASE; every view covers its whole table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.session import apply_settings

AS_OF = "2024-02-15 00:00:00"
SINCE = "2024-01-25 00:00:00"
STORED_BEFORE = "2024-01-15 00:00:00"

MESSAGES = """
SELECT
  concat('m', CAST(event_id AS STRING)) AS message_id,
  CASE user_id % 3 WHEN 0 THEN concat('t', CAST(event_id AS STRING))
                   WHEN 1 THEN concat('t', CAST(user_id AS STRING), '-', CAST(event_id % 40 AS STRING))
                   ELSE        concat('t', CAST(user_id AS STRING), '-', CAST(event_id % 5 AS STRING)) END AS thread_id,
  concat(CASE WHEN user_id % 8 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'noreply' ELSE 'NoReply' END
              WHEN user_id % 8 = 1 THEN 'support'
              ELSE concat('user', CAST(user_id AS STRING)) END, '@',
         CASE user_id % 7 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'acme.com' WHEN 2 THEN 'r.mailchimp.com'
                          WHEN 3 THEN 'chase.com' WHEN 4 THEN 'salesforce.com'
                          WHEN 5 THEN 'lists.example.org' ELSE 'yahoo.co.uk' END) AS sender_email,
  CASE user_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Jane Doe' WHEN 2 THEN 'Morning Digest' WHEN 3 THEN 'Acme Team'
                   WHEN 4 THEN concat('user', CAST(user_id AS STRING))
                   ELSE CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Ann Lee' END END AS sender_name,
  CASE event_type WHEN 'purchase' THEN concat('Your order #', CAST(event_id % 7 AS STRING))
                  WHEN 'view'     THEN concat('Weekly digest ', CAST(event_id % 3 AS STRING))
                  WHEN 'signup'   THEN concat('Re: welcome ', CAST(event_id % 11 AS STRING))
                  WHEN 'click'    THEN 'Fwd: link' ELSE concat('Alert ', CAST(event_id % 13 AS STRING)) END AS subject,
  ts - (user_id % 5) * INTERVAL '120' DAY AS date_received,
  CASE event_type WHEN 'signup' THEN 'primary' WHEN 'click' THEN 'social' WHEN 'view' THEN 'promotions'
                  WHEN 'purchase' THEN 'updates' ELSE 'forums' END AS category,
  concat_ws(',', CASE WHEN event_id % 97 = 0 THEN 'SPAM' WHEN event_id % 89 = 0 THEN 'SENT'
                      WHEN event_id % 4 <> 0 THEN 'INBOX' END,
                 CASE WHEN value < 20 + 25 * (user_id % 5) THEN 'UNREAD' END,
                 CASE WHEN event_id % 37 = 0 THEN 'STARRED' END,
                 CASE WHEN event_id % 10 = 0 THEN 'IMPORTANT' END,
                 CASE WHEN event_id % 3 = 0 THEN '_triage' END,
                 CASE WHEN event_id % 5 = 0 THEN concat('L', CAST(user_id % 4 AS STRING)) END) AS label_csv,
  value < 20 + 25 * (user_id % 5) AS is_unread,
  event_id AS ingest_seq
FROM {events}
"""

MAIL = r"""
SELECT concat('c', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS message_id,
       concat('c', CAST(conv_id AS STRING)) AS thread_id,
       CASE WHEN role = 'user' THEN concat('user', CAST(conv_id % 50 AS STRING), '@gmail.com')
            WHEN conv_id % 2 = 0 THEN 'Help@Chase.com' ELSE 'news@lists.example.org' END AS sender_email,
       concat('Topic ', CAST(conv_id % 9 AS STRING)) AS subject,
       TIMESTAMP '2022-06-01 00:00:00' + (conv_id % 20) * INTERVAL '35' DAY + turn * INTERVAL '1' HOUR AS date_received,
       concat(text, CASE turn % 3
         WHEN 1 THEN concat(chr(10), '> quoted line', chr(10), '>kept', chr(10), 'On Mon Alice wrote:', chr(10), 'old text')
         WHEN 2 THEN concat(chr(10), '-------- Forwarded', chr(10), 'old text') ELSE '' END) AS body,
       conv_id * 1000 + turn AS ingest_seq
FROM {conversations}
"""

RULES = """
SELECT * FROM (VALUES ('sender','help@chase.com','banking'), ('sender','user3@gmail.com',NULL),
       ('domain','chase.com','finance'), ('domain','gmail.com','personal'), ('domain','lists.example.org',NULL)) AS r(kind, rule_key, category)
"""

CONTACTS = """
SELECT c_custkey AS contact_id, CASE WHEN c_custkey % 3 = 0 THEN 'John Smith' ELSE c_name END AS name, concat('user', CAST(c_custkey AS STRING), '@',
       CASE c_custkey % 7 WHEN 0 THEN 'Gmail.com' WHEN 1 THEN 'acme.com' WHEN 2 THEN 'r.mailchimp.com' WHEN 3 THEN 'chase.com'
         WHEN 4 THEN 'salesforce.com' WHEN 5 THEN 'lists.example.org' ELSE 'yahoo.co.uk' END) AS email,
       CASE WHEN c_custkey % 3 > 0 THEN concat('+1-555-', CAST(c_custkey AS STRING)) END AS phone,
       CASE WHEN c_custkey % 2 = 0 THEN concat(' USER', CAST(c_custkey + 1 AS STRING), '@gmail.com') END AS second_email FROM {customer}
"""

FOLDERS = """
SELECT concat('r', CAST(r_regionkey AS STRING)) AS id,
       CASE r_name WHEN 'ASIA' THEN 'Deleted Items' WHEN 'EUROPE' THEN 'Junk Email' WHEN 'AFRICA' THEN 'Gelöschte Elemente' ELSE r_name END AS display_name,
       CAST(NULL AS STRING) AS parent_id, CAST(r_regionkey * 10 AS BIGINT) AS total_items FROM {region}
UNION ALL
SELECT concat('n', CAST(n_nationkey AS STRING)), CASE n_name WHEN 'CHINA' THEN 'Outbox' ELSE n_name END,
       concat('r', CAST(n_regionkey AS STRING)), CAST(n_nationkey AS BIGINT) FROM {nation}
UNION ALL
SELECT concat('c', CAST(c_custkey AS STRING)), c_name,
       concat('n', CAST(c_nationkey AS STRING)), CAST(c_custkey % 100 AS BIGINT) FROM {customer}
"""

ERRORS = """
SELECT event_id AS error_seq,
       CASE event_id % 4 WHEN 0 THEN 'bad payload' WHEN 1 THEN concat('Message m', CAST(event_id AS STRING), ': bad')
                         WHEN 2 THEN 'quota exceeded' ELSE concat('Message m', CAST(event_id % 500 AS STRING), ': gone') END AS message,
       CASE WHEN event_id % 8 = 4 THEN 'message' WHEN event_id % 8 = 2 THEN 'system' END AS kind,
       CASE WHEN event_id % 4 = 0 THEN concat('m', CAST(event_id % 800 AS STRING)) WHEN event_id % 12 = 1 THEN '' END AS message_id
FROM {events}
"""

# Raw messages, flat: the header texts are built from the message view.
RAW = """
SELECT CASE WHEN ingest_seq % 101 = 0 THEN CAST(NULL AS STRING) ELSE message_id END AS id,
       CASE WHEN ingest_seq % 103 = 0 THEN '' ELSE thread_id END AS thread_id,
       CASE ingest_seq % 4 WHEN 0 THEN concat(sender_name, ' <', sender_email, '>')
                           WHEN 1 THEN concat('"', sender_name, '" <', sender_email, '>')
                           WHEN 2 THEN concat('<', sender_email, '>')
                           ELSE concat(' ', sender_email, ' ') END AS from_text,
       CASE WHEN ingest_seq % 113 = 0 THEN 1 ELSE 0 END AS no_from,
       CASE WHEN ingest_seq % 127 = 0 THEN 1 ELSE 0 END AS broken_to,
       concat('"Last, First" <a', CAST(ingest_seq AS STRING), '@x.org>, b', CAST(ingest_seq % 9 AS STRING), '@y.org') AS to_text,
       CASE WHEN ingest_seq % 5 = 0 THEN concat('c', CAST(ingest_seq % 7 AS STRING), '@z.org, , <d@z.org>') END AS cc_text,
       CASE WHEN ingest_seq % 11 = 0 THEN CAST(NULL AS STRING) WHEN ingest_seq % 13 = 0 THEN '' ELSE subject END AS subject,
       date_received, category, label_csv, is_unread, sender_email, sender_name, ingest_seq,
       CASE WHEN ingest_seq % 107 = 0 THEN 1 ELSE 0 END AS no_date,
       CASE WHEN ingest_seq % 109 = 0 THEN 1 ELSE 0 END AS bad_date,
       concat('r', CAST(ingest_seq % 5 AS STRING)) AS folder_id
FROM {v_messages}
"""

DECISIONS = """
SELECT concat('r', CAST(ingest_seq % 4 AS STRING)) AS run_id, concat('b', CAST(ingest_seq % 2 AS STRING)) AS batch_id,
       sender_email, sender_name,
       CASE ingest_seq % 5 WHEN 0 THEN 'human' WHEN 1 THEN 'company' WHEN 2 THEN 'newsletter' WHEN 3 THEN 'automated' ELSE 'unknown' END AS presented_type,
       CASE WHEN ingest_seq % 6 = 0 THEN 'human' WHEN ingest_seq % 6 = 1 THEN 'newsletter' END AS reviewed_type,
       CASE ingest_seq % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'filter' ELSE 'unsubscribe' END AS user_decision,
       date_received AS decided_at, ingest_seq % 50 AS messages_archived, ingest_seq AS log_seq,
       concat_ws(',', CASE WHEN ingest_seq % 3 = 1 THEN 'filter' END, CASE WHEN ingest_seq % 50 > 0 THEN 'archive' END) AS actions_csv
FROM {v_messages}
"""

FILTERS = """
SELECT concat('f', CAST(min_seq AS STRING)) AS filter_id, sender_key AS from_addr, '_noise' AS add_csv,
       CASE min_seq % 3 WHEN 0 THEN 'INBOX' WHEN 1 THEN 'UNREAD,INBOX,UNREAD' ELSE 'STARRED' END AS remove_csv
FROM (SELECT lower(sender_email) AS sender_key, min(ingest_seq) AS min_seq FROM {v_messages} GROUP BY lower(sender_email)) t
"""

TABLES = ["region", "nation", "customer", "events", "documents", "pages", "conversations"]


def labels_of(csv: str):
    return F.when(F.col(csv) == "", F.array().cast("array<string>")).otherwise(F.split(csv, ","))


class Views:
    """The views as DataFrames for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = apply_settings(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **views: DataFrame) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used, **views)

    @cached_property
    def flat(self) -> DataFrame:
        return self.sql(MESSAGES)

    @cached_property
    def messages(self) -> DataFrame:
        return self._message_table(self.flat, "sender_name", labels_of("label_csv"), "category", "is_unread")

    @cached_property
    def flat_mail(self) -> DataFrame:
        return self.sql(MAIL)

    @cached_property
    def mail(self) -> DataFrame:
        return self._message_table(
            self.flat_mail, F.lit(""), F.array(F.lit("INBOX")), F.lit("unknown"), F.lit(True)
        )

    @staticmethod
    def _message_table(flat, name, labels, category, is_unread) -> DataFrame:
        def col(c):
            return F.col(c) if isinstance(c, str) else c

        none = F.array().cast("array<string>")
        return flat.select(
            "message_id",
            "thread_id",
            F.struct(F.col("sender_email").alias("email"), col(name).alias("name")).alias("sender"),
            F.struct(none.alias("to"), none.alias("cc")).alias("recipients"),
            "subject",
            "date_received",
            col(category).alias("category"),
            labels.alias("labels"),
            col(is_unread).alias("is_unread"),
            F.lit("").alias("snippet"),
            "ingest_seq",
        )

    @cached_property
    def bodies(self) -> DataFrame:
        return self.flat_mail.select("message_id", "body")

    @cached_property
    def rules(self) -> DataFrame:
        return self.sql(RULES)

    @cached_property
    def decisions(self) -> DataFrame:
        flat = self.sql(DECISIONS, v_messages=self.flat)
        return flat.withColumn("actions_taken", labels_of("actions_csv")).drop("actions_csv")

    @cached_property
    def filters(self) -> DataFrame:
        flat = self.sql(FILTERS, v_messages=self.flat)
        return flat.select(
            "filter_id",
            "from_addr",
            F.lit(None).cast("string").alias("query"),
            labels_of("add_csv").alias("add_labels"),
            labels_of("remove_csv").alias("remove_labels"),
        )

    @cached_property
    def contacts(self) -> DataFrame:
        """Some share a name and have no phone; some have two addresses."""

        def listed(*columns):
            entries = [F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value"), F.lit("home").alias("type"))) for c in columns]
            return F.array_compact(F.array(*entries))

        emails, phones = listed("email", "second_email"), listed("phone")
        return self.sql(CONTACTS).select("contact_id", "name", emails.alias("emails"), phones.alias("phones"))

    @cached_property
    def folders(self) -> DataFrame:
        return self.sql(FOLDERS)

    @cached_property
    def errors(self) -> DataFrame:
        return self.sql(ERRORS)

    @cached_property
    def raw(self) -> DataFrame:
        return self.sql(RAW, v_messages=self.flat)

    @cached_property
    def raw_gmail(self) -> DataFrame:
        """Gmail-shaped raw messages with a two-level MIME body."""

        def header(name, value):
            return F.struct(F.lit(name).alias("name"), value.alias("value"))

        upper = F.col("ingest_seq") % 2 == 0
        sender = F.struct(F.when(upper, "FROM").otherwise("From").alias("name"), F.col("from_text").alias("value"))
        to = F.when(F.col("broken_to") == 1, F.lit("not an address")).otherwise(F.col("to_text"))
        headers = F.array_compact(
            F.array(
                F.when(F.col("no_from") == 0, sender),
                header("To", to),
                F.when(F.col("cc_text").isNotNull(), header("cc", F.col("cc_text"))),
                F.when(F.col("subject").isNotNull(), header("Subject", F.col("subject"))),
                header("From", F.lit(None).cast("string")),
            )
        )
        tab = F.create_map(
            *[
                F.lit(x)
                for pair in {
                    "primary": "CATEGORY_PERSONAL",
                    "social": "CATEGORY_SOCIAL",
                    "promotions": "CATEGORY_PROMOTIONS",
                    "updates": "CATEGORY_UPDATES",
                }.items()
                for x in pair
            ]
        )
        labels = F.concat(labels_of("label_csv"), F.array_compact(F.array(F.try_element_at(tab, F.col("category")))))
        millis = F.unix_millis(F.col("date_received").cast("timestamp")).cast("string")
        date = F.when(F.col("bad_date") == 1, "not a date").when(F.col("no_date") == 0, millis)

        def part(mime, data):
            return F.struct(F.lit(mime).alias("mimeType"), F.struct(data.alias("data")).alias("body"))

        def b64(text):
            return F.translate(F.base64(F.encode(text, "UTF-8")), "+/\n\r", "-_")

        plain = part("text/plain", b64(F.concat(F.lit("Grüße: "), "from_text")))
        html = part("text/html", b64(F.concat(F.lit("<p>Hi</p>  <b>"), "sender_email", F.lit("</b>"))))
        leaves = F.when(F.col("ingest_seq") % 3 == 0, F.array(html)).otherwise(F.array(html, plain))
        inner = F.struct(
            F.lit("multipart/alternative").alias("mimeType"),
            F.struct(F.lit(None).cast("string").alias("data")).alias("body"),
            leaves.alias("parts"),
        )
        payload = F.struct(
            F.lit("multipart/mixed").alias("mimeType"),
            headers.alias("headers"),
            F.struct(F.lit(None).cast("string").alias("data")).alias("body"),
            F.array(inner).alias("parts"),
        )
        return self.raw.select(
            "id",
            F.col("thread_id").alias("threadId"),
            labels.alias("labelIds"),
            F.lit("snip").alias("snippet"),
            date.alias("internalDate"),
            payload.alias("payload"),
            "ingest_seq",
        )

    @cached_property
    def raw_graph(self) -> DataFrame:
        """Graph-shaped raw messages; folder r0 is the inbox."""

        def person(address, name=None):
            inner = F.struct(address.alias("address"), (F.lit("") if name is None else name).alias("name"))
            return F.struct(inner.alias("emailAddress"))

        missing = F.lit(None).cast("string")
        sender = person(F.when(F.col("broken_to") == 1, missing).otherwise(F.col("sender_email")), F.col("sender_name"))
        none = F.array().cast("array<string>")
        return self.raw.select(
            "id",
            F.col("thread_id").alias("conversationId"),
            F.when(F.col("no_from") == 0, sender).alias("from"),
            F.array(
                person(F.concat(F.lit("A"), F.col("ingest_seq").cast("string"), F.lit("@X.org"))), person(missing)
            ).alias("toRecipients"),
            F.when(F.col("cc_text").isNotNull(), F.array(person(F.lit("d@z.org")))).alias("ccRecipients"),
            "subject",
            F.when(F.col("no_date") == 0, F.date_format("date_received", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias(
                "receivedDateTime"
            ),
            F.when(F.col("ingest_seq") % 7 == 0, F.array(F.lit("Blue"), F.lit(""), F.lit("Red"))).otherwise(none).alias("categories"),
            (~F.col("is_unread")).alias("isRead"),
            F.col("folder_id").alias("parentFolderId"),
            F.lit("preview").alias("bodyPreview"),
            F.struct(F.when(F.col("ingest_seq") % 37 == 0, "flagged").otherwise("notFlagged").alias("flagStatus")).alias("flag"),
            F.when(F.col("ingest_seq") % 10 == 0, "high").otherwise("normal").alias("importance"),
            "ingest_seq",
        )
