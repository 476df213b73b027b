"""Named queries over the standard tables, each with the SQL that its rows are held against."""
