"""The registered queries, by area, each beside the SQL that it is checked against."""
