from cloakframe.functions.rules import Bucket, DropDigit, Suppress, Widen
from cloakframe.hierarchy import Hierarchy
from cloakframe.spec import AnonSpec

AGE = Hierarchy("age", (Bucket(5), Widen(10), Widen(20), Suppress()))
ZIP = Hierarchy("zip", (DropDigit(1), DropDigit(2), DropDigit(3), DropDigit(4), Suppress()))
MARITAL = Hierarchy("marital-status", (Suppress(),))
CRIME = [("Joe", "Separated", 29, 32042, "Murder"), ("Jill", "Single", 20, 32021, "Theft"), ("Sue", "Widowed", 24, 32024, "Traffic"), ("Abe", "Separated", 28, 32046, "Assault"), ("Bob", "Widowed", 25, 32045, "Piracy"), ("Amy", "Single", 23, 32027, "Indecency")]
PATIENT = [(25, "Male", 53711, "Flu"), (25, "Female", 53712, "Hepatitis"), (26, "Male", 53711, "Brochitis"), (27, "Male", 53710, "Broken Arm"), (27, "Female", 53712, "AIDS"), (28, "Male", 53711, "Hang Nail")]


def crime(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(CRIME)], "name string, `marital-status` string, age long, zip long, crime string, row_id long")
    return AnonSpec.by_index(df, [1, 2, 3], [True, False, False], "crime", order_key="row_id", hierarchies={"marital-status": MARITAL, "age": AGE, "zip": ZIP}, name="mini_crime")


def patient(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(PATIENT)], "age long, sex string, zip long, disease string, row_id long")
    return AnonSpec.by_index(df, [0, 2], [False, False], "disease", order_key="row_id", hierarchies={"age": AGE, "zip": ZIP}, name="mini_patient")
