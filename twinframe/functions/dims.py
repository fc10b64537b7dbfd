"""Dimension tables of fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: state code, postal code, zone, health region (none outside the contiguous states), name
STATES = """
01 AL America/Chicago 4 Alabama
02 AK America/Anchorage - Alaska
04 AZ America/Phoenix 9 Arizona
05 AR America/Chicago 6 Arkansas
06 CA America/Los_Angeles 9 California
08 CO America/Denver 8 Colorado
09 CT America/New_York 1 Connecticut
10 DE America/New_York 3 Delaware
11 DC America/New_York 3 District of Columbia
12 FL America/New_York 4 Florida
13 GA America/New_York 4 Georgia
15 HI Pacific/Honolulu - Hawaii
16 ID America/Boise 10 Idaho
17 IL America/Chicago 5 Illinois
18 IN America/Indiana/Indianapolis 5 Indiana
19 IA America/Chicago 7 Iowa
20 KS America/Chicago 7 Kansas
21 KY America/New_York 4 Kentucky
22 LA America/Chicago 6 Louisiana
23 ME America/New_York 1 Maine
24 MD America/New_York 3 Maryland
25 MA America/New_York 1 Massachusetts
26 MI America/Detroit 5 Michigan
27 MN America/Chicago 5 Minnesota
28 MS America/Chicago 4 Mississippi
29 MO America/Chicago 7 Missouri
30 MT America/Denver 8 Montana
31 NE America/Chicago 7 Nebraska
32 NV America/Los_Angeles 9 Nevada
33 NH America/New_York 1 New Hampshire
34 NJ America/New_York 2 New Jersey
35 NM America/Denver 6 New Mexico
36 NY America/New_York 2 New York
37 NC America/New_York 4 North Carolina
38 ND America/Chicago 8 North Dakota
39 OH America/New_York 5 Ohio
40 OK America/Chicago 6 Oklahoma
41 OR America/Los_Angeles 10 Oregon
42 PA America/New_York 3 Pennsylvania
44 RI America/New_York 1 Rhode Island
45 SC America/New_York 4 South Carolina
46 SD America/Chicago 8 South Dakota
47 TN America/Chicago 4 Tennessee
48 TX America/Chicago 6 Texas
49 UT America/Denver 8 Utah
50 VT America/New_York 1 Vermont
51 VA America/New_York 3 Virginia
53 WA America/Los_Angeles 10 Washington
54 WV America/New_York 3 West Virginia
55 WI America/Chicago 5 Wisconsin
56 WY America/Denver 8 Wyoming
72 PR America/Puerto_Rico - Puerto Rico
"""


def states(spark: SparkSession) -> DataFrame:
    """(geoid, postal, tz, hhs_region, name), a row for each state."""
    lines = spark.range(1).select(F.explode(F.split(F.lit(STATES.strip()), "\n")).alias("x"))
    row = lines.select(F.split("x", " ", 5).alias("x"))
    return row.select(F.get("x", F.lit(0)).alias("geoid"), F.get("x", F.lit(1)).alias("postal"), F.get("x", F.lit(2)).alias("tz"), F.get("x", F.lit(3)).try_cast("int").alias("hhs_region"), F.get("x", F.lit(4)).alias("name"))
