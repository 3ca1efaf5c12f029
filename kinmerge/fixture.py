"""Contacts derived from the retail tables, by one SQL text that Spark and DuckDB both run unchanged."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import ship

CONTACTS_SQL = """
WITH fn(i,v,a) AS (VALUES (0,'James','James'),(1,'Jim','Jim'),(2,'Robert','Robert'),(3,'Bob','Bob'),(4,'Elizabeth','Elizabeth'),(5,'Liz','Liz'),(6,'Mary','Mary'),(7,'Priya','Priya'),(8,'Wei','Wei'),(9,'Elena','Eléna'),(10,'Omar','Omár')),
ln(i,v,a) AS (VALUES (0,'Smith','Smith'),(1,'Johnson','Johnson'),(2,'Garcia','García'),(3,'Nguyen','Nguyễn'),(4,'Kowalski','Kowalski'),(5,'Okafor','Ọkafọr'),(6,'Rossi','Rossi'),(7,'Muller','Müller'),(8,'Patel','Patel'),(9,'Haddad','Ḥaddād'),(10,'Chen','Chén'),(11,'Scott','Scott'),(12,'Novak','Novák')),
dm(i,v) AS (VALUES (0,'gmail.com'),(1,'yahoo.com'),(2,'outlook.com'),(3,'acme.com'),(4,'googlemail.com')),
base AS (
  SELECT 'crm' AS source_id, c_custkey AS k, c_custkey AS p, 80 AS trust_rank FROM customer
  UNION ALL SELECT 'shop', o_orderkey, o_custkey, 50 FROM orders
  UNION ALL SELECT 'erp', s_suppkey, s_suppkey * 7, 30 FROM supplier
  UNION ALL SELECT 'web', event_id, 1 + (event_id * 7919) % (SELECT max(c_custkey) FROM customer), 40 FROM events),
r AS (SELECT *, (k * 31 + p * 17 + trust_rank) % 997 AS h, CASE WHEN p % 20 < 3 THEN p - p % 20 ELSE p END AS hp FROM base),
r2 AS (SELECT *, (p * 7) % 11 + CASE WHEN h % 6 = 0 AND (p * 7) % 11 IN (0, 2, 4) THEN 1 ELSE 0 END AS fi FROM r),
r3 AS (SELECT r.*, fn.v AS fv, CASE WHEN h % 13 = 5 THEN fn.a ELSE fn.v END AS f, ln.v AS lv, CASE WHEN h % 17 = 3 THEN ln.a ELSE ln.v END AS l, dm.v AS d
  FROM r2 AS r JOIN fn ON fn.i = CAST(r.fi AS INT) JOIN ln ON ln.i = CAST((r.hp * 5) % 13 AS INT) JOIN dm ON dm.i = CAST(r.p % 5 AS INT))
SELECT source_id, source_id || ':' || CAST(k AS STRING) AS record_id, p AS truth, trust_rank,
  CASE WHEN h % 23 = 0 THEN UPPER(f) ELSE f END AS first_name,
  CASE WHEN h % 29 = 0 THEN l || ' Jr' WHEN h % 37 = 0 THEN l || 'e' ELSE l END AS last_name,
  CASE WHEN h % 10 = 0 THEN NULL
       WHEN h % 31 = 0 THEN 'noemail@acme-store.com'
       ELSE lower(fv) || '.' || lower(lv) || CAST(p AS STRING) || CASE WHEN h % 4 = 1 THEN '+shop' ELSE '' END || '@' || d END AS email,
  CASE WHEN h % 3 = 0 THEN NULL
       WHEN h % 3 = 1 THEN '(727) ' || lpad(CAST(200 + hp % 700 AS STRING),3,'0') || '-' || lpad(CAST(hp % 10000 AS STRING),4,'0')
       ELSE '+1 727 ' || lpad(CAST(200 + hp % 700 AS STRING),3,'0') || ' ' || lpad(CAST(hp % 10000 AS STRING),4,'0') END AS phone,
  CASE WHEN h % 2 = 0 THEN NULL WHEN h = 501 THEN '1944-01-01' ELSE CAST(1945 + p % 60 AS STRING) || '-' || lpad(CAST(1 + p % 12 AS STRING),2,'0') || '-' || lpad(CAST(1 + p % 28 AS STRING),2,'0') END AS dob,
  CAST(10 + (hp * 13) % 9000 AS STRING) || CASE WHEN h % 2 = 0 THEN ' Main Street' ELSE ' Main St' END AS street,
  '33' || lpad(CAST(hp % 1000 AS STRING),3,'0') AS zip,
  CASE WHEN h % 7 = 0 THEN NULL WHEN hp % 4 = 0 THEN 'Tampa' WHEN hp % 4 = 1 THEN 'St. Pete' WHEN hp % 4 = 2 THEN 'São Luís' ELSE 'Largo' END AS city,
  CASE WHEN h % 4 = 0 THEN NULL ELSE 'Firm ' || CAST((p + h % 2) % 50 AS STRING) END AS company,
  CASE WHEN h % 3 = 1 THEN 'Engineer' WHEN h % 3 = 2 THEN 'Clerk' END AS job_title,
  CASE WHEN h % 50 = 3 THEN false WHEN h % 5 < 3 THEN true ELSE NULL END AS consent,
  CASE WHEN h % 60 = 7 THEN false WHEN h % 3 = 1 THEN true ELSE NULL END AS sms,
  '2025-' || lpad(CAST(1 + h % (CASE WHEN h % 50 = 3 OR h % 60 = 7 THEN 9 ELSE 12 END) AS STRING),2,'0') || '-' || lpad(CAST(1 + h % 28 AS STRING),2,'0') || 'T00:00:00Z' AS observed_at
FROM r3
"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contact record of the four derived sources, over the whole of their tables."""
    ship(spark)
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "supplier", "events")}
    return spark.sql(re.sub(r"\bFROM (customer|orders|supplier|events)\b", r"FROM {\1}", CONTACTS_SQL), **read)
