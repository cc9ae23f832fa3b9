"""Fixed calendar values."""

# Weekday rush hours.
RUSH_HOURS = (6, 7, 8, 9, 16, 17, 18, 19)

# The holiday dates the published results exclude.  They end in
# 2015; pass a longer list (or a holiday table) for later data.
HOLIDAYS = (
    "2013-07-04", "2013-09-02", "2013-11-28", "2013-11-29", "2013-12-24", "2013-12-25",
    "2014-01-01", "2014-01-20", "2014-02-17", "2014-05-26", "2014-07-04", "2014-09-01",
    "2014-11-27", "2014-11-28", "2014-12-24", "2014-12-25",
    "2015-01-01", "2015-01-19", "2015-02-16", "2015-05-25", "2015-07-03", "2015-09-07",
    "2015-11-26", "2015-11-27", "2015-12-24", "2015-12-25",
)
