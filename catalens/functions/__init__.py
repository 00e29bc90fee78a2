"""Column functions: no function here touches a DataFrame or starts a job."""
