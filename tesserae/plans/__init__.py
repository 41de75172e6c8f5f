"""Named queries over the sample tables, each beside the SQL that checks it."""
