"""DataFrame operators: filters, dashboards, reports, detection, audit."""
