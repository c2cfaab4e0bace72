"""formloom: file formats as queryable data, on Spark."""
