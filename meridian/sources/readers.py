"""Readers of feeds and bulk files into typed DataFrames; bad rows are kept apart or skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURE = "struct<id:string,properties:struct<mag:double,place:string,time:bigint,updated:bigint,url:string,tsunami:int,title:string>,geometry:struct<type:string,coordinates:array<double>>>"
#: Public knowledge-base properties and the relationship each stands for (fixed values).
PROPERTIES = {"P17": "LOCATED_IN", "P131": "LOCATED_IN", "P127": "OWNED_BY", "P159": "HEADQUARTERED_IN", "P31": "INSTANCE_OF", "P361": "PART_OF", "P138": "NAMED_AFTER", "P607": "CONFLICT", "P108": "EMPLOYER", "P463": "MEMBER_OF", "P241": "MILITARY_BRANCH", "P137": "OPERATOR", "P355": "SUBSIDIARY", "P126": "MAINTAINED_BY", "P749": "PARENT_ORGANIZATION"}
_GEONAMES = "geonameid bigint, name string, asciiname string, alternatenames string, latitude double, longitude double, feature_class string, feature_code string, country_code string, cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population bigint, elevation int, dem int, timezone string, modified date"


def seismic_feed(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON earthquake feed: one row a feature that has an id, a time and coordinates."""
    raw = spark.read.schema(f"features array<{_FEATURE}>").json(path, multiLine=True)
    f = raw.select(F.explode("features").alias("f")).select("f.*")
    good = f.where("id is not null and properties.time is not null and size(geometry.coordinates) >= 2")
    at = lambda i: F.get("geometry.coordinates", F.lit(i))
    return good.select(F.timestamp_millis("properties.time").alias("time"), F.col("id").alias("usgs_id"), F.col("properties.mag").alias("magnitude"), F.col("properties.place").alias("place"), at(0).alias("lon"), at(1).alias("lat"), at(2).alias("depth_km"), (F.col("properties.tsunami") == 1).alias("tsunami"))


def rss_feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS 2.0 items that have a title and a link."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string").load(path)
    return items.where("title is not null and link is not null").select(F.col("link").alias("source_url"), "title", "description")


def html_items(pages: DataFrame) -> DataFrame:
    """Title, link and description of raw web pages, where the page has a title."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    text = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<p[^>]*>(.*?)</p>", 1), r"<[^>]+>", " "))
    return pages.select("page_id", F.col("url").alias("source_url"), title.alias("title"), text.alias("description")).where("title <> '' and source_url is not null")


def geonames(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated gazetteer of 19 columns as LOCATION entities."""
    rows = spark.read.csv(path, sep="\t", schema=_GEONAMES, nullValue="", quote="")
    about = F.concat(F.lit("City in "), "country_code", F.lit(". Population: "), F.col("population").cast("string"))
    return rows.select(F.concat(F.lit("geo:"), "geonameid").alias("entity_id"), F.lit("LOCATION").alias("entity_type"), "name", F.split("alternatenames", ",").alias("aliases"), F.coalesce(about, F.lit("City")).alias("description"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), "population")


def kb_entities(spark: SparkSession, path: str) -> DataFrame:
    """``id<TAB>label[<TAB>description]`` lines; lines without a label are skipped."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where("size(p) >= 2 and trim(p[1]) <> ''")
    return parts.select(F.col("p")[0].alias("qid"), F.trim(F.col("p")[1]).alias("name"), F.get("p", F.lit(2)).alias("description"))


def kb_triples(spark: SparkSession, path: str) -> DataFrame:
    """``subject<TAB>property<TAB>object`` lines of mapped properties, as relationship types."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where("size(p) >= 3")
    kinds = F.create_map(*(F.lit(x) for pair in PROPERTIES.items() for x in pair))
    got = parts.select(F.col("p")[0].alias("s"), F.try_element_at(kinds, F.col("p")[1]).alias("type"), F.col("p")[2].alias("o"))
    return got.where("type is not null")


def text_documents(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Every .txt file of a folder as (path, text), in batch or as a stream whose checkpoint takes
    the place of moving files away."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.format("text").option("wholetext", True).option("pathGlobFilter", "*.{txt,TXT}").load(path)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def pdf_documents(spark: SparkSession, path: str, extract) -> DataFrame:
    """Every .pdf file as (path, text); ``extract(bytes) -> str`` is the installation's own PDF
    library. A file it fails on has a null text."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(b):
            try:
                return extract(b)
            except Exception:  # noqa: BLE001  one bad file must not stop the scan
                return None

        return s.map(one)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(path).select("path", run("content").alias("text"))


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A CSV or other delimited bulk source with a header."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, mode="DROPMALFORMED")


def indicators(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines indicator source; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def catalog(spark: SparkSession, database: str = "default") -> DataFrame:
    """(table, column, type) of a database."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def simulated_flights(spark: SparkSession) -> DataFrame:
    """Three constant aircraft, as a stand-in for a live feed."""
    return spark.sql("SELECT * FROM VALUES ('MRD101', 'a00001', 'N101', 32000, 48.1, 11.5, NULL), ('MRD202', 'a00002', 'N202', 28000, 51.0, 3.2, '7700'), ('MRD303', 'a00003', 'N303', 35000, 40.4, -3.7, NULL) AS t(callsign, icao24, registration, altitude_ft, lat, lon, squawk)")


def simulated_vessels(spark: SparkSession) -> DataFrame:
    """Three constant ships, as a stand-in for a live feed."""
    return spark.sql("SELECT * FROM VALUES ('Aster', '200000001', 'CARGO', 'NL', 51.9, 4.1), ('Borage', '200000002', 'TANKER', 'GR', 37.9, 23.6), ('Clover', '200000003', 'FISHING', 'NO', 60.4, 5.3) AS t(name, mmsi, vessel_type, flag, lat, lon)")


#: An invented deck of entities to start a graph with: name, type, aliases, watch status.
SEEDS = (("Port of Aldermere", "LOCATION", ("Aldermere",), "NONE"), ("Brightwater Shipping", "ORGANIZATION", ("Brightwater", "BWS"), "ACTIVE"), ("Corvane Air", "ORGANIZATION", (), "ACTIVE"), ("Ilsa Marrow", "PERSON", ("I. Marrow",), "ACTIVE"), ("Tern Strait", "LOCATION", (), "NONE"))


def seed_deck(spark: SparkSession) -> DataFrame:
    """(entity_id, name, entity_type, aliases, watch_status) of the deck; ids follow the names, so that
    seeding again adds nothing."""
    rows = spark.createDataFrame([(n, t, list(a), w) for n, t, a, w in SEEDS], "name string, entity_type string, aliases array<string>, watch_status string")
    return rows.select(F.concat(F.lit("seed-"), F.substring(F.sha2(F.lower("name"), 256), 1, 16)).alias("entity_id"), "*")
