"""Small dictionaries an installation starts with, and their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (code, name, provider, category, selective, usual stages).
EXAM_TYPES = (
    ("NON_SELECTIVE", "Non-selective Admissions (Local Authority CAF)", "Local Authority", "Non-selective", False, 1),
    ("GL_ASSESSMENT", "GL Assessment 11+", "GL Assessment", "Selective", True, 1),
    ("CEM", "CEM 11+", "CEM (Centre for Evaluation and Monitoring)", "Selective", True, 1),
    ("ISEB_CPT", "ISEB Common Pre-Test", "Independent Schools Examinations Board", "Selective", True, 2),
    ("ISEB_CE", "ISEB Common Entrance (11+/13+)", "Independent Schools Examinations Board", "Selective", True, 1),
    ("LONDON_CONSORTIUM", "London 11+ Consortium", "London 11+ Consortium", "Selective", True, 1),
    ("SUTTON_SET", "Sutton Selective Eligibility Test (SET)", "Sutton Grammar Schools Consortium", "Selective", True, 2),
    ("CSSE", "Consortium of Selective Schools in Essex (CSSE)", "CSSE", "Selective", True, 1),
    ("SCHOOL_OWN", "School's Own Examination", "School Direct / Internal", "Selective", True, 1),
    ("FAIR_BANDING", "Fair Banding Assessment", "NFER / GL Assessment", "Banding", False, 1),
    ("SPECIALIST_APTITUDE", "Specialist Aptitude Assessment (Up to 10%)", "School Direct / Specialist Board", "Aptitude", False, 1),
    ("AUDITION", "Audition & Practical Arts Assessment", "School Arts Department", "Aptitude", False, 1),
    ("FAITH_SIF", "Faith Priority Admissions (SIF Required)", "Diocese / Governing Body", "Faith SIF", False, 1),
    ("SEN_EHCP", "SEN / EHCP Referral Assessment", "Local Authority SEND Panel", "SEN Referral", False, 1),
)
# Fixed values: (code, name, region, usual exam type).
CONSORTIA = (
    ("SUTTON_SET", "Sutton Selective Eligibility Test Consortium", "Greater London", "SUTTON_SET"),
    ("KENT_PESE", "Kent PESE (Kent Test)", "Kent", "GL_ASSESSMENT"),
    ("SLOUGH_11PLUS", "Slough 11+ Consortium", "Berkshire", "GL_ASSESSMENT"),
    ("CSSE_ESSEX", "Consortium of Selective Schools in Essex (CSSE)", "Essex", "CSSE"),
    ("BEXLEY_TEST", "Bexley Selection Test", "Greater London", "GL_ASSESSMENT"),
    ("TRAFFORD_CONSORTIUM", "Trafford Grammar Schools Consortium", "Greater Manchester", "GL_ASSESSMENT"),
    ("BIRMINGHAM_CONSORTIUM", "The Grammar Schools in Birmingham Consortium", "West Midlands", "GL_ASSESSMENT"),
    ("LONDON_11PLUS_CONSORTIUM", "London 11+ Consortium", "Greater London", "LONDON_CONSORTIUM"),
    ("BUCKINGHAMSHIRE_STT", "Buckinghamshire Secondary Transfer Testing (STT)", "Buckinghamshire", "GL_ASSESSMENT"),
    ("MEDWAY_TEST", "Medway Test Consortium", "Kent", "GL_ASSESSMENT"),
    ("KINGSTON_TIFFIN", "Kingston Selective Admissions (Tiffin Schools)", "Greater London", "GL_ASSESSMENT"),
    ("BARNET_SELECTIVE", "Barnet Selective Schools", "Greater London", "GL_ASSESSMENT"),
    ("REDBRIDGE_11PLUS", "Redbridge 11+ Selection", "Greater London", "GL_ASSESSMENT"),
    ("DEVON_COLYTON", "Colyton Grammar Admissions", "South West", "GL_ASSESSMENT"),
    ("WIRRAL_11PLUS", "Wirral 11+ Consortium", "North West", "GL_ASSESSMENT"),
)
# Fixed values: (code, name, kind of governance).
GOVERNING_BODIES = (
    ("HARRIS_FEDERATION", "Harris Federation", "Multi-Academy Trust (MAT)"),
    ("ARK_SCHOOLS", "Ark Schools", "Multi-Academy Trust (MAT)"),
    ("FOLIO_EDUCATION_TRUST", "Folio Education Trust", "Multi-Academy Trust (MAT)"),
    ("KEVI_FOUNDATION", "The King Edward VI Foundation Birmingham", "Foundation / Trust"),
    ("GDST", "Girls' Day School Trust (GDST)", "Foundation / Trust"),
    ("UNITED_LEARNING", "United Learning", "Multi-Academy Trust (MAT)"),
    ("OASIS_COMMUNITY_LEARNING", "Oasis Community Learning", "Multi-Academy Trust (MAT)"),
    ("HABERDASHERS_TRUST", "Haberdashers' Academies Trust South", "Multi-Academy Trust (MAT)"),
    ("GLF_SCHOOLS", "GLF Schools", "Multi-Academy Trust (MAT)"),
    ("LEIGH_ACADEMIES_TRUST", "Leigh Academies Trust", "Multi-Academy Trust (MAT)"),
    ("OUTWOOD_GRANGE_ACADEMIES", "Outwood Grange Academies Trust", "Multi-Academy Trust (MAT)"),
    ("MERCERS_COMPANY", "The Mercers' Company Education Trust", "Charitable Foundation / Trust"),
    ("DIOCESE_OF_WESTMINSTER", "Roman Catholic Diocese of Westminster", "Diocesan Board"),
    ("SOUTHWARK_RC_DIOCESE", "Roman Catholic Archdiocese of Southwark", "Diocesan Board"),
    ("LDBS_LONDON", "London Diocesan Board for Schools (CofE)", "Diocesan Board"),
    ("TIFFIN_ACADEMY_TRUST", "The Tiffin Girls' School Academy Trust", "Single Academy Trust"),
    ("WILSONS_ACADEMY_TRUST", "Wilson's School Academy Trust", "Single Academy Trust"),
    ("QE_BARNET_TRUST", "Queen Elizabeth's School, Barnet Academy Trust", "Single Academy Trust"),
    ("LOCAL_AUTHORITY_MAINTAINED", "Local Authority Maintained", "Local Authority Maintained"),
)


def exam_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAM_TYPES, "code string, name string, provider string, category string, is_selective boolean, typical_stages int")


def consortia(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONSORTIA, "code string, name string, region string, default_exam string")


def governing_bodies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GOVERNING_BODIES, "code string, name string, governance_type string")


def consortia_with_exam(spark: SparkSession) -> DataFrame:
    e = exam_types(spark).select(F.col("code").alias("default_exam"), F.col("name").alias("exam_name"))
    return consortia(spark).join(F.broadcast(e), "default_exam", "left").orderBy("name")


def stages_with_names(stages: DataFrame) -> DataFrame:
    """Stage rows with the names of their exam type and consortium; both dictionaries are the fixed lists above."""
    spark = stages.sparkSession
    e = exam_types(spark).select(F.col("code").alias("exam_type"), F.col("name").alias("exam_name"), "is_selective")
    c = consortia(spark).select(F.col("code").alias("consortium"), F.col("name").alias("consortium_name"))
    return stages.join(F.broadcast(e), "exam_type", "left").join(F.broadcast(c), "consortium", "left")
