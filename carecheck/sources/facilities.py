"""The raw facility listing derived from the benchmark tables.

The driver's star schema holds no care facilities, so customers (or orders) become
facilities and the documents their descriptions. The expressions are plain SQL that
other engines run unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carecheck.session import spread


RAW_EXPRESSIONS = {
    "facility_id": "concat('F', lpad(cast(k as string),6,'0'))",
    "name": "name",
    "facilityTypeId": "case k%7 when 0 then 'Hospital' when 1 then 'clinic' when 2 then 'hospital' when 3 then 'dentist' when 4 then 'farmacy' when 5 then 'doctor' else 'pharmacy' end",
    "address_stateOrRegion": "case k%12 when 0 then 'Bihar' when 1 then 'Kerala' when 2 then 'Tamilnadu' when 3 then 'Up' when 4 then 'Mumbai' when 5 then 'Delhi NCR' when 6 then 'Karnataka' when 7 then 'Jammu And Kashmir' when 8 then 'Pune' when 9 then 'Atlantis' when 10 then null else 'West Bengal' end",
    "address_city": "case when k%41=0 then null when k%50=0 then 'Gaya' when k%50=1 then 'Araria' when k%50=2 then 'Jamui' when k%50=3 then 'Nadia' else concat('City_',cast(k%50 as string)) end",
    "address_postalCode": "case when k%23=0 then null when k%5=0 then concat(cast(1000+k%9000 as string),'.0') else cast(110001+k%700000 as string) end",
    "latitude": "case when k%29=0 then null when k%31=0 then 'n/a' when k%97=0 then '51.50' when k%3=0 then '25.50' else concat(cast(cast(floor((800+(k*37)%2700)/100) as int) as string),'.',lpad(cast((800+(k*37)%2700)%100 as string),2,'0')) end",
    "longitude": "case when k%29=0 then null when k%3=0 then '85.00' else concat(cast(cast(floor((6900+(k*53)%2800)/100) as int) as string),'.',lpad(cast((6900+(k*53)%2800)%100 as string),2,'0')) end",
    "description": "case when k%19=0 then null else concat(coalesce(text,''), case k%13 when 0 then ' We provide 24x7 emergency care.' when 1 then ' Round-the-clock casualty.' when 2 then ' Recipient of W.HO award 2019.' when 3 then ' ISO 9001:2027 certified.' when 4 then ' ISO 9001:2015 certified.' else '' end) end",
    "capacity": "case when k%10=0 then cast(k%300 as string) when k%17=0 then 'unknown' else null end",
    "numberDoctors": "case when k%8=0 then concat(cast(k%40 as string),'.0') else null end",
    "yearEstablished": "case when k%12=0 then cast(1950+k%70 as string) else null end",
    "facebookLink": "case when k%3=0 then concat('https://fb.example/',cast(k as string)) when k%11=0 then '' else null end",
    "twitterLink": "cast(null as string)",
    "instagramLink": "cast(null as string)",
    "linkedinLink": "cast(null as string)",
    "websites": "cast(null as string)",
    "officialWebsite": "case when k%5=1 then concat('https://site.example/',cast(k as string)) else null end",
    "recency_of_page_update": "case when k%4=0 then concat(cast(2020+k%6 as string),'-0',cast(1+k%9 as string),'-15') when k%37=0 then 'yesterday' else null end",
    "specialties": """case k%9 when 0 then '["cardiology","dentistry"]' when 1 then '["medicaloncology"]' when 2 then '["orthopedicsurgery","pediatrics"]' when 3 then '["pediatricdentistry"]' when 4 then 'Cardiology | nephrology' when 5 then '' when 6 then null when 7 then '[]' else '["gynecologyandobstetrics","neonatologyperinatalmedicine"]' end""",
    "procedure": """case k%5 when 0 then '["root canal treatment"]' when 1 then '["open","heart surgery"]' when 2 then '[]' when 3 then null else '["bypass surgery"]' end""",
    "equipment": """case k%8 when 0 then '["ECG machine","Echo"]' when 1 then '["bandage"]' when 2 then '[]' when 3 then null when 4 then 'x-ray, ultrasound' when 5 then '["CT scanner","MRI"]' when 6 then '["dental chair"]' else '["ventilator","incubator"]' end""",
    "capability": """case k%6 when 0 then '["ICU","open 24/7"]' when 1 then '["multispeciality hospital"]' when 2 then '["trauma care"]' when 3 then '' when 4 then null else '["dialysis","has 1 doctor on staff"]' end""",
}


def _raw(base: DataFrame) -> DataFrame:
    return base.selectExpr(*[f"{sql} AS {name}" for name, sql in RAW_EXPRESSIONS.items()])


def customer_facilities(spark: SparkSession, folder: str) -> DataFrame:
    """One raw facility per customer, described by the document of the same key."""
    customer = spread(spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", "c_name"), "c_custkey")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return _raw(
        customer.join(documents, customer.c_custkey == documents.doc_id, "left").selectExpr(
            "c_custkey AS k", "c_name AS name", "text"
        )
    )


def order_facilities(spark: SparkSession, folder: str) -> DataFrame:
    """One raw facility per order, for bench-size runs; documents are reused in turn."""
    orders = spread(spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey"), "o_orderkey")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    last = documents.agg({"doc_id": "max"}).first()[0]
    return _raw(
        orders.join(documents, orders.o_orderkey % (last + 1) == documents.doc_id, "left").selectExpr(
            "o_orderkey AS k", "concat('Order facility ', o_orderkey) AS name", "text"
        )
    )
