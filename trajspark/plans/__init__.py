"""Views over the driver tables, the query registry and the SQL oracle twins."""
