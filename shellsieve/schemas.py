"""Fixed schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

RISK_LEVELS = ("Low", "Medium", "High", "Critical")

FINDING_TYPES = (
    "DangerousCommand",
    "HardcodedSecret",
    "InputValidationMissing",
    "SensitiveFileAccess",
    "InsecureNetworkAccess",
    "CommandInjectionRisk",
    "PrivilegeEscalationRisk",
    "FilePermissionIssue",
    "OtherSecurityRisk",
)

SCRIPTS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("readable", T.BooleanType()),
])

RULES = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("finding_type", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("command_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("rule_no", T.IntegerType()),
    T.StructField("enabled", T.BooleanType()),
])

# The nine fields every report carries, in report order.
REPORT_FINDING = T.StructType([
    T.StructField("finding_type", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("column", T.LongType()),
    T.StructField("code_snippet", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("risk_score", T.FloatType()),
])

# A findings table adds the rule and its place in the order of passes.
FINDINGS = T.StructType(REPORT_FINDING.fields + [
    T.StructField("rule_id", T.StringType()),
    T.StructField("risk_rank", T.IntegerType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("rule_no", T.IntegerType()),
])

LEVEL_COUNTS = T.StructType([
    T.StructField("critical", T.LongType()),
    T.StructField("high", T.LongType()),
    T.StructField("medium", T.LongType()),
    T.StructField("low", T.LongType()),
])

REPORT = T.StructType([
    T.StructField("analyzed_files", T.ArrayType(T.StringType())),
    T.StructField("total_scripts", T.LongType()),
    T.StructField("findings", T.ArrayType(REPORT_FINDING)),
    T.StructField("total_findings", T.LongType()),
    T.StructField("findings_by_risk_level", LEVEL_COUNTS),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
