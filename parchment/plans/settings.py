"""Settings of the registered queries."""

from parchment.config import Settings

#: The test tables' letters are of the years 1992 to 1998.
SUITED = Settings(as_of="1998-12-31", first_year=1990)
