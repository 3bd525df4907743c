"""Input schemas. Money is DoubleType, counts and scores IntegerType.

FIXED VALUES: names, types and order of the columns are the input contract."""

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

PRODUCT_SCHEMA = StructType([
    StructField("product_id", StringType(), True),
    StructField("name", StringType(), True),
    StructField("category", StringType(), True),
    StructField("cost", DoubleType(), True),
    StructField("quantity", IntegerType(), True),
])

FACILITY_SCHEMA = StructType([
    StructField("borrower_id", StringType(), True),
    StructField("borrower_name", StringType(), True),
    StructField("credit_score", IntegerType(), True),
    StructField("debt_to_income", DoubleType(), True),
    StructField("loan_to_value", DoubleType(), True),
    StructField("employment_years", IntegerType(), True),
    StructField("payment_history_score", IntegerType(), True),
    StructField("industry", StringType(), True),
    StructField("company_size", StringType(), True),
    StructField("collateral_type", StringType(), True),
    StructField("seniority", StringType(), True),
    StructField("facility_type", StringType(), True),
    StructField("exposure_amount", DoubleType(), True),
    StructField("outstanding_amount", DoubleType(), True),
    StructField("undrawn_amount", DoubleType(), True),
    StructField("loan_term", IntegerType(), True),
    StructField("region", StringType(), True),
])

# Columns a facility feed may carry in addition to FACILITY_SCHEMA.
OPTIONAL_FACILITY_FIELDS = (
    StructField("interest_rate", DoubleType(), True),
    StructField("fee_rate", DoubleType(), True),
    StructField("ead_amount", DoubleType(), True),
)


# Columns without which no model can run; every other column of FACILITY_SCHEMA may be
# absent, and the formulas then use their neutral factor or fallback.
REQUIRED_FACILITY_COLUMNS = ("borrower_id", "credit_score", "industry", "collateral_type", "facility_type",
                             "exposure_amount")
ABSENT_OK = tuple(f.name for f in FACILITY_SCHEMA.fields if f.name not in REQUIRED_FACILITY_COLUMNS)
CORRUPT = "_corrupt_record"


def feed_schema(present) -> StructType:
    """The known fields among the columns that a feed has, in the order of the contract.
    A missing required column is an error that names it."""
    present = set(present)
    missing = [c for c in REQUIRED_FACILITY_COLUMNS if c not in present]
    if missing:
        raise ValueError(f"the feed lacks required columns: {missing}")
    return StructType([f for f in (*FACILITY_SCHEMA.fields, *OPTIONAL_FACILITY_FIELDS) if f.name in present])


def facility_schema(*extra: str) -> StructType:
    """FACILITY_SCHEMA plus the named optional columns, in the given order."""
    by_name = {f.name: f for f in OPTIONAL_FACILITY_FIELDS}
    unknown = [e for e in extra if e not in by_name]
    if unknown:
        raise ValueError(f"unknown optional facility columns: {unknown}")
    return StructType(FACILITY_SCHEMA.fields + [by_name[e] for e in extra])
