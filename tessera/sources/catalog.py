"""SRC-07 / SRC-08: the ERP catalog as small DataFrames.

The catalog is fixed-size metadata (14 tables, ~150 columns), so it is built
from literals and may be broadcast freely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: ERP schema (table -> [(column, type)]) -------------------
# Union of the DDL and the two extra columns the corpus relies on
# (PAC_MNT_PROJECTS.Project_ID, PAC_MNT_RESOURCES.Email).
ERP_SCHEMA: dict[str, list[tuple[str, str]]] = {
    "SRM_COMPANIES": [("Company_ID", "INTEGER"), ("Company_Name", "VARCHAR(255)"), ("Company_Code", "VARCHAR(50)"),
                      ("Principal_ID", "INTEGER"), ("Industry", "VARCHAR(100)"), ("Status", "VARCHAR(20)"),
                      ("Created_Date", "TIMESTAMP"), ("Modified_Date", "TIMESTAMP")],
    "SRM_PROJECTS": [("Project_ID", "INTEGER"), ("Project_Name", "VARCHAR(255)"), ("Company_ID", "INTEGER"),
                     ("Parent_ID", "INTEGER"), ("Start_Date", "DATE"), ("End_Date", "DATE"), ("Status", "VARCHAR(50)"),
                     ("Description", "TEXT"), ("Created_Date", "TIMESTAMP"), ("Modified_Date", "TIMESTAMP")],
    "SRM_CONTACTS": [("Contact_ID", "INTEGER"), ("Company_ID", "INTEGER"), ("Contact_Name", "VARCHAR(255)"),
                     ("Email", "VARCHAR(255)"), ("Phone", "VARCHAR(50)"), ("Role", "VARCHAR(100)"),
                     ("Is_Primary", "BOOLEAN"), ("Status", "VARCHAR(20)"), ("Created_Date", "TIMESTAMP"),
                     ("Modified_Date", "TIMESTAMP")],
    "PAC_MNT_PROJECTS": [("Project_ID", "INTEGER"), ("Project_Code", "VARCHAR(50)"), ("Project_Name", "VARCHAR(255)"),
                         ("Budget", "DECIMAL(15,2)"), ("Actual_Cost", "DECIMAL(15,2)"), ("Revenue", "DECIMAL(15,2)"),
                         ("Status", "VARCHAR(50)"), ("Cost_Center", "VARCHAR(50)"), ("Department", "VARCHAR(100)"),
                         ("Start_Date", "DATE"), ("End_Date", "DATE"), ("Created_Date", "TIMESTAMP"),
                         ("Modified_Date", "TIMESTAMP")],
    "PAC_MNT_RESOURCES": [("Resource_Code", "VARCHAR(50)"), ("Resource_Name", "VARCHAR(255)"),
                          ("Resource_Type", "VARCHAR(50)"), ("Email", "VARCHAR(255)"), ("Cost_Rate", "DECIMAL(10,2)"),
                          ("Billing_Rate", "DECIMAL(10,2)"), ("Currency", "VARCHAR(3)"), ("Availability", "VARCHAR(50)"),
                          ("Capacity", "DECIMAL(5,2)"), ("Department", "VARCHAR(100)"), ("Created_Date", "TIMESTAMP"),
                          ("Modified_Date", "TIMESTAMP")],
    "CLNTCLASS": [("ClntClass_ID", "INTEGER"), ("Class_Code", "VARCHAR(50)"), ("Class_Name", "VARCHAR(255)"),
                  ("Description", "TEXT"), ("Priority", "INTEGER"), ("Status", "VARCHAR(20)"),
                  ("Created_Date", "TIMESTAMP")],
    "CLNTSUPP": [("Support_ID", "INTEGER"), ("Company_Code", "VARCHAR(50)"), ("ClntClass", "VARCHAR(50)"),
                 ("Support_Type", "VARCHAR(100)"), ("Priority", "VARCHAR(20)"), ("Status", "VARCHAR(50)"),
                 ("Reported_Date", "DATE"), ("Resolved_Date", "DATE"), ("Description", "TEXT"),
                 ("Resolution", "TEXT"), ("Created_Date", "TIMESTAMP"), ("Modified_Date", "TIMESTAMP")],
    "CLNTRESPONS": [("Response_ID", "INTEGER"), ("Project_Code", "VARCHAR(50)"), ("Unique_Name", "VARCHAR(100)"),
                    ("Response_Date", "DATE"), ("Response_Type", "VARCHAR(100)"), ("Status", "VARCHAR(50)"),
                    ("Response_Content", "TEXT"), ("Created_Date", "TIMESTAMP"), ("Modified_Date", "TIMESTAMP")],
    "PROJCNTRTS": [("Contract_ID", "INTEGER"), ("Project_Code", "VARCHAR(50)"), ("Company_Code", "VARCHAR(50)"),
                   ("Contract_Number", "VARCHAR(100)"), ("Contract_Type", "VARCHAR(50)"),
                   ("Contract_Value", "DECIMAL(15,2)"), ("Start_Date", "DATE"), ("End_Date", "DATE"),
                   ("Status", "VARCHAR(50)"), ("Terms", "TEXT"), ("Created_Date", "TIMESTAMP"),
                   ("Modified_Date", "TIMESTAMP")],
    "PROJSTAFF": [("Staff_ID", "INTEGER"), ("Project_Code", "VARCHAR(50)"), ("Resource_Code", "VARCHAR(50)"),
                  ("Role", "VARCHAR(100)"), ("Allocation_Percent", "DECIMAL(5,2)"), ("Start_Date", "DATE"),
                  ("End_Date", "DATE"), ("Status", "VARCHAR(50)"), ("Bill_Rate", "DECIMAL(10,2)"),
                  ("Cost_Rate", "DECIMAL(10,2)"), ("Created_Date", "TIMESTAMP"), ("Modified_Date", "TIMESTAMP")],
    "PROJEVISION": [("Revision_ID", "INTEGER"), ("Project_Code", "VARCHAR(50)"), ("Revision_Number", "VARCHAR(20)"),
                    ("Revision_Date", "DATE"), ("Revision_Type", "VARCHAR(100)"), ("Previous_Value", "TEXT"),
                    ("New_Value", "TEXT"), ("Description", "TEXT"), ("Approved_By", "VARCHAR(255)"),
                    ("Approval_Date", "DATE"), ("Created_Date", "TIMESTAMP")],
    "BIZ_OPP_GEN_PROPERTIES": [("Opportunity_ID", "INTEGER"), ("Company_ID", "INTEGER"),
                               ("Opportunity_Name", "VARCHAR(255)"), ("Estimated_Value", "DECIMAL(15,2)"),
                               ("Probability", "DECIMAL(5,2)"), ("Stage", "VARCHAR(50)"),
                               ("Expected_Close_Date", "DATE"), ("Status", "VARCHAR(50)"), ("Owner", "VARCHAR(255)"),
                               ("Created_Date", "TIMESTAMP"), ("Modified_Date", "TIMESTAMP")],
    "BIZ_COM_SUP_PROPERTIES": [("Supplier_ID", "INTEGER"), ("Company_ID", "INTEGER"), ("Supplier_Type", "VARCHAR(100)"),
                               ("Payment_Terms", "VARCHAR(100)"), ("Credit_Limit", "DECIMAL(15,2)"),
                               ("Rating", "VARCHAR(20)"), ("Status", "VARCHAR(50)"), ("Created_Date", "TIMESTAMP"),
                               ("Modified_Date", "TIMESTAMP")],
    "PAC_PURGE_FINANCIAL_LIST": [("Purge_ID", "INTEGER"), ("Table_Name", "VARCHAR(100)"),
                                 ("Record_Type", "VARCHAR(50)"), ("Cutoff_Date", "DATE"), ("Records_Count", "INTEGER"),
                                 ("Purge_Status", "VARCHAR(50)"), ("Purge_Date", "DATE"),
                                 ("Archived_Location", "VARCHAR(500)"), ("Created_Date", "TIMESTAMP")],
}

PRIMARY_KEYS = {
    "SRM_COMPANIES": "Company_ID", "SRM_PROJECTS": "Project_ID", "SRM_CONTACTS": "Contact_ID",
    "PAC_MNT_PROJECTS": "Project_Code", "PAC_MNT_RESOURCES": "Resource_Code", "CLNTCLASS": "ClntClass_ID",
    "CLNTSUPP": "Support_ID", "CLNTRESPONS": "Response_ID", "PROJCNTRTS": "Contract_ID", "PROJSTAFF": "Staff_ID",
    "PROJEVISION": "Revision_ID", "BIZ_OPP_GEN_PROPERTIES": "Opportunity_ID", "BIZ_COM_SUP_PROPERTIES": "Supplier_ID",
    "PAC_PURGE_FINANCIAL_LIST": "Purge_ID",
}

# (table, column, referenced table, referenced column)
FOREIGN_KEYS = [
    ("SRM_PROJECTS", "Company_ID", "SRM_COMPANIES", "Company_ID"),
    ("SRM_PROJECTS", "Parent_ID", "SRM_PROJECTS", "Project_ID"),
    ("SRM_CONTACTS", "Company_ID", "SRM_COMPANIES", "Company_ID"),
    ("CLNTSUPP", "Company_Code", "SRM_COMPANIES", "Company_Code"),
    ("CLNTSUPP", "ClntClass", "CLNTCLASS", "Class_Code"),
    ("CLNTRESPONS", "Project_Code", "PAC_MNT_PROJECTS", "Project_Code"),
    ("PROJCNTRTS", "Project_Code", "PAC_MNT_PROJECTS", "Project_Code"),
    ("PROJCNTRTS", "Company_Code", "SRM_COMPANIES", "Company_Code"),
    ("PROJSTAFF", "Project_Code", "PAC_MNT_PROJECTS", "Project_Code"),
    ("PROJSTAFF", "Resource_Code", "PAC_MNT_RESOURCES", "Resource_Code"),
    ("PROJEVISION", "Project_Code", "PAC_MNT_PROJECTS", "Project_Code"),
    ("BIZ_OPP_GEN_PROPERTIES", "Company_ID", "SRM_COMPANIES", "Company_ID"),
    ("BIZ_COM_SUP_PROPERTIES", "Company_ID", "SRM_COMPANIES", "Company_ID"),
]


def qualified_columns() -> list[str]:
    """``TABLE.COLUMN`` in upper case for every catalog column."""
    return [f"{t}.{c}".upper() for t, cols in ERP_SCHEMA.items() for c, _ in cols]


def catalog_tables(spark: SparkSession) -> DataFrame:
    rows = [(t, PRIMARY_KEYS.get(t), len(cols)) for t, cols in ERP_SCHEMA.items()]
    return spark.createDataFrame(rows, "table_name string, primary_key string, n_columns int")


def catalog_columns(spark: SparkSession) -> DataFrame:
    rows = [(t, i + 1, c, ty, PRIMARY_KEYS.get(t) == c) for t, cols in ERP_SCHEMA.items()
            for i, (c, ty) in enumerate(cols)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string, "
                                       "is_primary_key boolean")


def catalog_fks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOREIGN_KEYS, "table_name string, column_name string, ref_table string, "
                                               "ref_column string")


def register_catalog(spark: SparkSession) -> None:
    """Register ``cat_tables``, ``cat_columns``, ``cat_fks`` temp views."""
    catalog_tables(spark).createOrReplaceTempView("cat_tables")
    catalog_columns(spark).createOrReplaceTempView("cat_columns")
    catalog_fks(spark).createOrReplaceTempView("cat_fks")


def spark_type(ddl_type: str) -> str:
    t = ddl_type.upper()
    if t.startswith("VARCHAR") or t == "TEXT":
        return "string"
    if t.startswith("DECIMAL"):
        return t.lower()
    return {"INTEGER": "int", "DATE": "date", "TIMESTAMP": "timestamp", "BOOLEAN": "boolean"}[t]


def erp_struct(table: str) -> str:
    """DDL string usable as ``spark.read.schema(...)`` for one ERP table."""
    return ", ".join(f"{c} {spark_type(ty)}" for c, ty in ERP_SCHEMA[table])


def empty_erp_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Typed, empty DataFrames for all 14 tables (registered as temp views)."""
    out = {}
    for t in ERP_SCHEMA:
        df = spark.createDataFrame([], erp_struct(t))
        df.createOrReplaceTempView(t)
        out[t] = df
    return out


__all__ = ["ERP_SCHEMA", "PRIMARY_KEYS", "FOREIGN_KEYS", "qualified_columns", "catalog_tables",
           "catalog_columns", "catalog_fks", "register_catalog", "erp_struct", "empty_erp_tables", "F"]
